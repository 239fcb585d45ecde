"""DuckDB statements for the operators that SQL can express.

They are written from the results' definitions, with their own patterns and
numbers, not from the modules they check.
"""

from __future__ import annotations

DOCS = """d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents)"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain_words(text: str) -> str:
    return (f"regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), "
            r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")


CONTAMINATION = f"""
WITH {DOCS},
w AS (SELECT rid, doc_id, {plain_words('t')} AS ws FROM d),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id,
             {plain_words("coalesce(text, '')")} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[pos + 1:pos + n], ' ') AS k
       FROM (SELECT item_id, ws, least(13, len(ws)) AS n,
                    unnest(range(len(ws) - least(13, len(ws)) + 1)) AS pos
             FROM i WHERE len(ws) > 0)),
dw AS (SELECT rid, n, pos, array_to_string(ws[pos + 1:pos + n], ' ') AS k
       FROM (SELECT rid, ws, n, unnest(range(greatest(len(ws) - n + 1, 0))) AS pos
             FROM w, (SELECT DISTINCT n FROM iw))),
hit AS (SELECT rid, item_id, pos, dw.n FROM dw JOIN iw ON dw.k = iw.k AND dw.n = iw.n),
places AS (SELECT rid, count(DISTINCT p) AS n_hit
           FROM (SELECT rid, unnest(range(pos, pos + n)) AS p FROM hit) GROUP BY rid),
found AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN places USING (rid) LEFT JOIN found USING (rid)
"""

REPEATS = rf"""
WITH {DOCS},
w AS (SELECT rid, coalesce(doc_id, 9223372036854775807) AS id, doc_id,
             list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT rid, id, pos, array_to_string(ws[pos + 1:pos + 50], ' ') AS k
        FROM (SELECT rid, id, ws, unnest(range(greatest(len(ws) - 49, 0))) AS pos FROM w)),
least AS (SELECT k, min(id) AS low FROM win GROUP BY k),
gone AS (SELECT DISTINCT rid, unnest(range(pos, pos + 50)) AS p
         FROM win JOIN least USING (k) WHERE id > low),
words AS (SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM w),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS k
         FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid),
lost AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (rid) LEFT JOIN lost USING (rid)
"""

ARCHIVE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
led AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS leader FROM p),
bits AS (SELECT *, array_to_string(list_transform(string_split(sha1(h), ''), lambda x: substr(
  '0000000100100011010001010110011110001001101010111100110111101111',
  4 * (instr('0123456789abcdef', x) - 1) + 1, 4)), '') AS b FROM led)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda j: substr(
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
         + 16 * CAST(substr(b, 5 * j + 1, 1) AS INTEGER)
         + 8 * CAST(substr(b, 5 * j + 2, 1) AS INTEGER)
         + 4 * CAST(substr(b, 5 * j + 3, 1) AS INTEGER)
         + 2 * CAST(substr(b, 5 * j + 4, 1) AS INTEGER)
         + CAST(substr(b, 5 * j + 5, 1) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM leader THEN 'response' ELSE 'revisit' END
         AS record_type,
       CASE WHEN page_id IS DISTINCT FROM leader THEN leader END AS refers_to
FROM bits
"""

_QUOTE = """["'']?"""
_ASSIGN = (
    "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
    "|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    rf"{_QUOTE}\x20*[:=]\x20*{_QUOTE}([A-Za-z0-9+/_.=-]+)")


def _spans(name: str, pattern: str, wanted: str = "true", group: int = 0, source: str = "d") -> str:
    """Matches with their places: what is before them, and the matches before."""
    return f"""{name}_cut AS (
  SELECT rid, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS s,
         regexp_extract_all(t, '{pattern}', {group}) AS g
  FROM {source} WHERE regexp_matches(t, '{pattern}')),
{name} AS (
  SELECT rid, CAST(a AS BIGINT) AS a, CAST(a + length(m[i + 1]) AS BIGINT) AS b, m[i + 1] AS c
  FROM (SELECT *, coalesce(list_sum(list_transform(s[1:i + 1], lambda x: length(x))), 0)
               + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0) AS a
        FROM (SELECT *, unnest(range(len(m))) AS i FROM {name}_cut))
  WHERE {wanted})"""


# c * log2(c) for counts 0 to 20, in 2 ** -20 bits.
_TERM = "CAST(round(1048576 * n * log2(n)) AS BIGINT)"
_HEX = "^([0-9a-f]+|[0-9A-F]+)$"
_ALLOWED = [
    "^[0-9+/_=-]+$", "^[A-Z]?[a-z]+$", "^[A-Z]+$", "^[A-Za-z]+([+/_=-]+[A-Za-z]+)*[+/_=-]*$",
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"]


def _allowed(text: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, '{p}')" for p in _ALLOWED) + ")"


def _alphabet(letters: str) -> str:
    """The first ten letters, and as many of the others as follow in order."""
    rest = ""
    for letter in reversed(letters[10:]):
        rest = f"({letter}{rest})?"
    return letters[:10] + rest


_SAMPLES = "|".join(["EXAMPLE", "example", "0123456789", _alphabet(LOWER), _alphabet(UPPER)])
_KEY = "[A-Za-z0-9+/_=-]"
_TAKEN = "chr(65535)"
_BARE = "regexp_replace({}, '^[+/_=-]+', '')"

SECRETS = f"""
WITH {DOCS},
{_spans("assign", _ASSIGN, "length(g[i + 1]) >= 8", 2)},
{_spans("access", "AKIA[A-Z0-9]+", "length(m[i + 1]) >= 16")},
{_spans("hexes", "[0-9a-f]{32,}")},
{_spans("candidate", _KEY + "{20,}")},
base AS (SELECT rid, a, 0 AS k, b FROM assign UNION ALL SELECT rid, a, 1, b FROM access
         UNION ALL SELECT rid, a, 2, b FROM hexes),
-- What fixed patterns leave of a text, character by character.
rest_text AS (
  SELECT d.rid, d.doc_id, array_to_string(list_transform(string_split(t, ''), lambda c, i:
           CASE WHEN len(list_filter(taken, lambda s: s.a < i AND i <= s.b)) > 0
                THEN {_TAKEN} ELSE c END), '') AS t
  FROM d JOIN (SELECT rid, list(struct_pack(a := a, b := b)) AS taken FROM base GROUP BY rid)
       USING (rid)),
{_spans("rest", _KEY + "{20,}", source="rest_text")},
left_over AS (
  SELECT rest.* FROM rest JOIN rest_text USING (rid)
  WHERE (a = 0 OR substr(t, a, 1) <> {_TAKEN} OR regexp_matches(c, '^[+/_=-]'))
    AND (substr(t, b + 1, 1) <> {_TAKEN} OR regexp_matches(c, '[+/_=-]$'))
    AND NOT {_allowed("c")} AND NOT {_allowed(_BARE.format("c"))}),
named AS (SELECT rid, a, c, true AS whole FROM candidate WHERE NOT {_allowed("c")}
          UNION ALL SELECT rid, a, c, false FROM left_over),
-- Samples cut a candidate.
parts AS (
  SELECT rid, whole, a AS first, c AS body, regexp_matches(c, '{_SAMPLES}') AS cut,
         string_split_regex(c, '{_SAMPLES}') AS s, regexp_extract_all(c, '{_SAMPLES}') AS m
  FROM named),
pieces AS (
  SELECT rid, whole, first AS a, body AS c FROM parts WHERE NOT cut
  UNION ALL
  SELECT rid, whole, a, c FROM (
    SELECT rid, whole, s[i + 1] AS c, first
           + coalesce(list_sum(list_transform(s[1:i], lambda x: length(x))), 0)
           + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0) AS a
    FROM (SELECT *, unnest(range(len(s))) AS i FROM parts WHERE cut))
  WHERE length(c) >= 20 AND NOT {_allowed(_BARE.format("c"))}),
tried AS (SELECT *, substr(c, CAST(pos + 1 AS BIGINT), 20) AS w
          FROM (SELECT *, unnest(range(length(c) - 19)) AS pos FROM pieces)),
summed AS (SELECT *, list_sum(list_transform(map_values(list_aggregate(
             string_split(w, ''), 'histogram')), lambda n: {_TERM})) AS s,
           regexp_extract(substr(c, 1, CAST(pos AS BIGINT)), '[A-Za-z0-9]*$') || w
             || regexp_extract(substr(c, CAST(pos + 21 AS BIGINT)), '^[A-Za-z0-9]*') AS token
           FROM tried),
hot AS (SELECT DISTINCT rid, whole, a + min(pos) AS a, 3 AS k, a + max(pos) + 20 AS b FROM summed
        WHERE s <= floor(1048576 * 20 * (log2(20) - CASE
          WHEN regexp_matches(token, '{_HEX}') AND regexp_matches(token, '[a-fA-F]')
          THEN 2.9 ELSE 3.75 END))
        GROUP BY rid, whole, summed.a),
found AS (SELECT DISTINCT rid, a, k, b FROM hot h WHERE NOT whole OR NOT EXISTS (
  SELECT 1 FROM base x WHERE x.rid = h.rid AND x.a < h.b AND h.a < x.b)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM found),
spelled AS (SELECT *, ['assign', 'access', 'hex', 'entropy'][k + 1] || ':' || a || ':' || b AS x
            FROM every),
listed AS (
  SELECT rid, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access,
         count(*) FILTER (WHERE k = 2) AS n_hex,
         string_agg(x, ',' ORDER BY a, k, b) FILTER (WHERE k < 3) AS base,
         string_agg(x, ',' ORDER BY a, k, b) AS spans
  FROM spelled GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (rid)
"""

CHATS = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'),
                   (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), ''
                         ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
                       FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<turn>') + length(replace(replace(replace(
                  role, '\', '\b'), '<', '\l'), chr(10), '\n')) + 1
                + length(replace(replace(text, '\', '\b'), '<', '\l'))
                + length('</turn>') + 1) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

PHRASES = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws
      FROM pieces),
f AS (SELECT lang, size, list_aggregate(ws[pos + 1:pos + size], 'string_agg', ' ') AS phrase,
             count(*) AS f
      FROM (SELECT lang, ws, size, unnest(range(len(ws) - size + 1)) AS pos
            FROM w, (VALUES (1), (2), (3)) AS s(size) WHERE len(ws) >= size)
      GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws
      FROM f WHERE size > 1 AND f >= 10),
cuts AS (SELECT *, array_to_string(ws[:k], ' ') AS p, array_to_string(ws[k + 1:], ' ') AS q
         FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
scored AS (SELECT cuts.*, x.f AS l, y.f AS r,
                  CAST(1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS BIGINT) AS score
           FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = p
                JOIN f y ON y.lang = cuts.lang AND y.phrase = q),
best AS (SELECT * FROM scored
         QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_pairs AS (SELECT lang, array_to_string(ws[i:i + 1], ' ') AS phrase, max(a) AS longer
                FROM (SELECT *, unnest([1, 2]) AS i FROM c WHERE size = 3) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inner_pairs o
           ON best.lang = o.lang AND best.phrase = o.phrase
         WHERE o.longer IS NULL OR 100 * o.longer < 50 * best.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""

# Label, notice, edits allowed, words that must be unchanged.
_NOTICES = [
    ("mit", "mit license", 1, 1),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 5, 0),
    ("apache", "apache license", 1, 1),
    ("apache", "you may not use this file except in compliance with the license", 4, 0),
    ("gpl", "general public license", 2, 1),
    ("lgpl", "lesser general public license", 2, 1),
    ("agpl", "affero general public license", 2, 1),
    ("bsd", "bsd license", 1, 1),
    ("bsd", "redistribution and use in source and binary forms with or without modification", 5, 0),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", 5, 0),
    ("mpl", "mozilla public license", 2, 1),
    ("epl", "eclipse public license", 2, 1),
    ("cc", "creative commons attribution", 2, 1),
    ("cc", "licensed under cc by", 1, 0),
    ("unlicense", "free and unencumbered software released into the public domain", 4, 0)]

# With k edits, a run has one of k + 1 parts of the notice unchanged.
_PARTS = ", ".join(
    f"('{label}', '{text}', {edits}, '{' '.join(text.split()[:fixed])}', "
    f"{[text[len(text) * i // (edits + 1):len(text) * (i + 1) // (edits + 1)] for i in range(edits + 1)]})"
    for label, text, edits, fixed in _NOTICES)

LICENSES = f"""
WITH {DOCS},
w AS (SELECT rid, doc_id, ws, array_to_string(ws, ' ') AS line
      FROM (SELECT rid, doc_id, {plain_words('t')} AS ws FROM d)),
exact AS (SELECT rid, unnest(list_filter(range(len(ws)), lambda i: ws[i + 1:i + len(p)] = p)) AS place, label
          FROM w, (VALUES (['mit', 'license'], 'mit'), (['apache', 'license'], 'apache'),
                          (['general', 'public', 'license'], 'gpl')) AS b(p, label)
          WHERE line LIKE '%license%'),
base AS (SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word FROM exact GROUP BY rid),
notices(label, notice, edits, fixed, parts) AS (VALUES {_PARTS}),
likely AS (SELECT rid, ws, n.* FROM w, notices n
           WHERE len(list_filter(parts, lambda x: contains(line, x))) > 0),
begun AS (SELECT * FROM (SELECT *, unnest(range(len(ws))) AS i FROM likely)
          WHERE fixed = '' OR ws[i + 1] = fixed),
runs AS (SELECT *, array_to_string(ws[i + 1:i + m], ' ') AS run
         FROM (SELECT *, unnest(range(greatest(1, len(string_split(notice, ' ')) - edits),
                                      len(string_split(notice, ' ')) + edits + 1)) AS m FROM begun)
         WHERE i + m <= len(ws)),
close AS (SELECT rid, label, notice, levenshtein(run, notice) AS e FROM runs
          WHERE abs(strlen(run) - strlen(notice)) <= edits AND levenshtein(run, notice) <= edits),
scores AS (SELECT rid, max(1.0::DOUBLE - e / strlen(notice)) AS score FROM close GROUP BY rid),
names AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
                 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE is_base) AS base_labels
          FROM (SELECT rid, label, true AS is_base FROM exact
                UNION ALL SELECT rid, label, false FROM close) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base,
       first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0::DOUBLE) END AS score
FROM w LEFT JOIN base USING (rid) LEFT JOIN scores USING (rid) LEFT JOIN names USING (rid)
"""
