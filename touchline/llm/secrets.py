"""Secret scans in DataFrame expressions only.

Three fixed patterns (assignments, access keys, long hex runs) are found by
splitting the text at their matches: the pieces between and the matches
themselves give every position.  Besides, every candidate string (a run of at
least ``WINDOW`` key characters) is walked by a window of ``WINDOW``
characters.  The walk keeps the count of each key character; a step takes one
character out and one in, and corrects the sum of c * log2(c) by those two
counts, so the Shannon entropy of each window costs no new count.  A window is
of the hex class inside a token (a run between separators) that is hex of one
case, and of the base64 class elsewhere.  The stretch from the first to the last
window whose entropy reaches its class's threshold is a further span, unless the
candidate is on the allow-list or the span touches one of a fixed pattern.
Sample words and alphabets cut a candidate; what fixed patterns leave of one, if
joined to them by a separator, is a candidate of its own.

Entropies are compared as integers (2 ** -20 bit), so that results do not
depend on rounding.  Rows are neither moved nor gathered.

A step of the walk costs the same at any place of a candidate of any length, and
texts are cut in stretches, so a megabyte of key characters or of joined words takes
seconds.  Joining spans still costs more the more spans one text has (34 s for 20,000
of them, measured on a loaded machine).

Defined results: a null text is empty and has no spans (and stays null when
redacted); positions count code points, end exclusive; repeated rows are each
reported; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm import frames

# The patterns.  Every match of assign counts as found, those with
# a short value are dropped afterwards; a run that is too short has no longer
# part, so the other two ask for the length at once.
ASSIGN = (r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
          r"|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
          r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
SHORTEST_VALUE = 8
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Bits a character in a window; of a random string about 3.4 (hex), 4.1 (base64).
THRESHOLDS = {"hex": 2.9, "base64": 3.75}
HEX_CLASS = r"^(?:[0-9a-f]+|[0-9A-F]+)$"
#: Before and after each separator; a token of digits alone is not hex.
TOKEN_EDGE = r"(?<=[+/_=-])|(?=[+/_=-])"
HEX_TOKEN = r"^(?=.*[a-fA-F])(?:[0-9a-f]+|[0-9A-F]+)$"
#: Candidates that are no secrets: numbers, words, words joined by separators
#: and UUIDs.
ALLOWED = (
    r"^[0-9+/_=-]+$", r"^[A-Z]?[a-z]+$", r"^[A-Z]+$",
    r"^[A-Za-z][A-Za-z+/_=-]*$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
)
#: Sample words, and alphabets or digits in order, are no secrets; what is before
#: and after them may be.
SAMPLES = (r"EXAMPLE|example|0123456789"
           r"|abcdefghij(?:k(?:l(?:m(?:n(?:o(?:p(?:q(?:r(?:s(?:t(?:u(?:v(?:w(?:x(?:yz?)?)?)?)?)?)?)?)?)?)?)?)?)?)?)?"
           r"|ABCDEFGHIJ(?:K(?:L(?:M(?:N(?:O(?:P(?:Q(?:R(?:S(?:T(?:U(?:V(?:W(?:X(?:YZ?)?)?)?)?)?)?)?)?)?)?)?)?)?)?)?")
#: Stands for each character of a fixed pattern's match; and what is left between
#: such matches, where a separator joins it to them.
TAKEN = "\uffff"
REST = (rf"(?<![A-Za-z0-9+/_=-])(?:(?<!{TAKEN})|(?=[+/_=-]))[A-Za-z0-9+/_=-]{{20,}}+"
        rf"(?:(?!{TAKEN})|(?<=[+/_=-]))")
LEADING = r"^[+/_=-]+"

SCALE = 1 << 20
#: Numbers whose running sums are made at once (the rest by blocks of them).
BLOCK = 256
#: Counts of characters in a long, and the bits of each (up to WINDOW).
PACKED, COUNT_BITS = 12, 5
#: Characters of a text that are cut out of at once.
STRETCH = 4096


def count_terms() -> list[int]:
    """c * log2(c) for the counts 0 to WINDOW, as integers."""
    return [round(SCALE * c * math.log2(c)) if c else 0 for c in range(WINDOW + 1)]


def sum_limit(kind: str) -> int:
    """The entropy of a window reaches the threshold if its sum is at most this."""
    return math.floor(SCALE * WINDOW * (math.log2(WINDOW) - THRESHOLDS[kind]))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used
    (inside a lambda, an expression is evaluated anew at each step)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sums_before(numbers: Column) -> Column:
    """For each element, the sum of those before it (an array of longs)."""
    def run(part: Column, start: Column) -> Column:
        return F.aggregate(
            part, F.struct(F.array().cast("array<bigint>").alias("a"),
                           start.cast("long").alias("s")),
            lambda acc, v: F.struct(F.concat(acc["a"], F.array(acc["s"])).alias("a"),
                                    (acc["s"] + v).alias("s")),
            lambda acc: acc["a"])

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, v: a + v)

    def blockwise(values: Column) -> Column:
        last = F.floor((F.size(values) - 1) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                             lambda b: F.slice(values, b * BLOCK + 1, BLOCK))
        return bound(blocks, lambda x: bound(
            run(F.transform(x, total), F.lit(0)), lambda starts: F.flatten(F.transform(
                F.arrays_zip(x.alias("b"), starts.alias("s")), lambda z: run(z["b"], z["s"])))))

    return bound(numbers, lambda values: F.when(
        F.size(values) <= BLOCK, run(values, F.lit(0))).otherwise(blockwise(values)))


def span(kind: int, start: Column, end: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), F.lit(kind).alias("kind"),
                    end.cast("long").alias("end"))


SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def cut(df: DataFrame, text: str, name: str, pattern: str) -> DataFrame:
    """Adds <name>_between, <name>_match and <name>_start (only where it matches)."""
    body, pat = F.col(f"`{text}`"), F.lit(pattern)
    df = df.withColumn(f"{name}_any", F.coalesce(F.rlike(body, pat), F.lit(False)))
    any_ = F.col(f"{name}_any")
    df = df.withColumns({
        f"{name}_between": F.when(any_, F.split(body, pattern, -1)),
        f"{name}_match": F.when(any_, F.regexp_extract_all(body, pat, F.lit(0))),
    })
    between, match = F.col(f"{name}_between"), F.col(f"{name}_match")
    lengths = F.transform(F.arrays_zip(between.alias("b"), match.alias("m")), lambda z:
                          F.length(z["b"]) + F.coalesce(F.length(z["m"]), F.lit(0)))
    return df.withColumn(f"{name}_start", F.when(any_, F.transform(
        F.arrays_zip(F.slice(between, 1, F.size(match)).alias("b"),
                     F.slice(sums_before(lengths), 1, F.size(match)).alias("s")),
        lambda z: z["s"] + F.length(z["b"]))))


def walked(candidate: Column) -> Column:
    """First and last window of the candidate with enough entropy (or nulls)."""
    terms = F.array(*[F.lit(t).cast("long") for t in count_terms()])
    codes = F.transform(F.split(candidate, ""), lambda c: F.position(c, F.lit(ALPHABET)))
    hexes = F.flatten(F.transform(F.split(candidate, TOKEN_EDGE, -1), lambda t: F.array_repeat(
        F.rlike(t, F.lit(HEX_TOKEN)), F.length(t))))
    return bound(F.struct(codes.alias("codes"), hexes.alias("hexes")),
                 lambda x: walk(x["codes"], x["hexes"], terms))


def walk(codes: Column, hexes: Column, terms: Column) -> Column:
    """The windows of a candidate, given as places in ``ALPHABET`` and whether
    each character is in a hex token.

    Counts of the window's characters are packed into a few longs, so that a step
    changes two of them.  The sum of c * log2(c) changes by a step between
    neighbouring terms for each of the two characters.
    """
    def shift(name: str, value: Column, places: Column) -> Column:
        return F.call_function(name, value, places)

    def bits(code: Column) -> Column:
        return (code % PACKED * COUNT_BITS).cast("int")

    def word(code: Column) -> Column:
        return F.floor(code / PACKED).cast("int")

    def count(packed: Column, code: Column) -> Column:
        value = shift("shiftright", F.get(packed, word(code)), bits(code))
        return value.bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("int")

    def change(packed: Column, code: Column, by: int) -> Column:
        one = shift("shiftleft", F.lit(by).cast("long"), bits(code))
        return F.transform(packed, lambda n, j: F.when(j == word(code), n + one).otherwise(n))

    up = F.array(*[F.lit(b - a).cast("long") for a, b in zip(count_terms(), count_terms()[1:])])

    def moved(acc: Column, i: Column) -> Column:
        """Counts and sum after a character is taken out (if any) and one put in."""
        def out(x: Column) -> Column:
            return bound(count(x["n"], x["went"]), lambda times: F.struct(
                change(x["n"], x["went"], -1).alias("n"),
                (x["s"] - F.get(up, times - 1)).alias("s")))

        def into(x: Column) -> Column:
            return bound(F.get(codes, i) - 1, lambda came: F.struct(
                change(x["n"], came, 1).alias("n"),
                (x["s"] + F.get(up, count(x["n"], came))).alias("s")))

        before = F.struct(acc["n"].alias("n"), acc["s"].alias("s"))
        left = F.when(i >= WINDOW, bound(
            F.struct(acc["n"].alias("n"), acc["s"].alias("s"),
                     (F.get(codes, i - WINDOW) - 1).alias("went")), out)).otherwise(before)
        return bound(left, into)

    def step(acc: Column, i: Column) -> Column:
        return bound(F.struct(
            moved(acc, i).alias("m"),
            F.when(F.get(hexes, i), acc["other"]).otherwise(i).alias("other")),
            lambda x: after(acc, i, x["m"], x["other"]))

    def after(acc: Column, i: Column, now: Column, other: Column) -> Column:
        limit = F.when(i - other >= WINDOW, F.lit(sum_limit("hex"))).otherwise(
            F.lit(sum_limit("base64")))
        hot = (i >= WINDOW - 1) & (now["s"] <= limit)
        at = i - (WINDOW - 1)
        return F.struct(
            now["n"].alias("n"), now["s"].alias("s"), other.alias("other"),
            F.when(hot, F.coalesce(acc["first"], at)).otherwise(acc["first"]).alias("first"),
            F.when(hot, at).otherwise(acc["last"]).alias("last"))

    zero = F.struct(
        F.array_repeat(F.lit(0).cast("long"), -(-len(ALPHABET) // PACKED)).alias("n"),
        F.lit(0).cast("long").alias("s"), F.lit(-1).alias("other"),
        F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero, step,
                       lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def allowed(candidate: Column) -> Column:
    out = F.lit(False)
    for pattern in ALLOWED:
        out = out | F.rlike(candidate, F.lit(pattern))
    return out


def hot_spans(name: str, known: Callable[[Column], Column]) -> Column:
    """The entropy spans of the matches of ``name`` that are not ``known``."""
    def pieces(z: Column) -> Column:
        between = F.split(z["m"], SAMPLES, -1)
        lengths = F.transform(
            F.arrays_zip(between.alias("b"), F.regexp_extract_all(
                z["m"], F.lit(SAMPLES), F.lit(0)).alias("m")),
            lambda x: F.length(x["b"]) + F.coalesce(F.length(x["m"]), F.lit(0)))
        return F.filter(
            F.transform(F.arrays_zip(between.alias("b"), sums_before(lengths).alias("s")),
                        lambda x: F.struct((z["s"] + x["s"]).alias("s"), x["b"].alias("m"))),
            lambda x: (F.length(x["m"]) >= WINDOW) & ~allowed(F.regexp_replace(x["m"], LEADING, "")))

    unknown = F.filter(
        F.arrays_zip(F.col(f"{name}_start").alias("s"), F.col(f"{name}_match").alias("m")),
        lambda z: ~known(z["m"]))
    unknown = F.flatten(F.transform(unknown, lambda z: F.when(
        F.rlike(z["m"], F.lit(SAMPLES)), pieces(z)).otherwise(
            F.array(F.struct(z["s"].alias("s"), z["m"].alias("m"))))))
    walks = F.transform(unknown, lambda z: F.struct(z["s"].alias("s"), walked(z["m"]).alias("w")))
    return F.transform(F.filter(walks, lambda x: x["w"]["first"].isNotNull()), lambda x: span(
        3, x["s"] + x["w"]["first"], x["s"] + x["w"]["last"] + WINDOW))


def stretches(text: Column) -> Column:
    """The text in stretches of ``STRETCH`` characters."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{STRETCH}}}"), F.lit(0))


def between(parts: Column, start: Column, end: Column) -> Column:
    """What ``parts`` (stretches) have from ``start`` to ``end``: only those two and
    the ones between them are read, not the text from its beginning."""
    first = F.floor(start / STRETCH).cast("int")
    last = F.floor((end - 1) / STRETCH).cast("int")
    return F.when(end > start, F.array_join(F.transform(F.sequence(first, last), lambda b: F.substring(
        F.get(parts, b), (F.greatest(start - b * STRETCH, F.lit(0)) + 1).cast("int"),
        (F.least(end - b * STRETCH, F.lit(STRETCH))
         - F.greatest(start - b * STRETCH, F.lit(0))).cast("int"))), "")).otherwise(F.lit(""))


def joined(spans: Column) -> Column:
    """Sorted spans as (start, end), those that overlap joined, and the end before."""
    def step(acc: Column, s: Column) -> Column:
        end = F.greatest(acc["end"], s["end"])
        return F.when((s["start"] > acc["end"]) | acc["end"].isNull(), F.struct(
            F.concat(acc["out"], F.array(F.struct(
                acc["start"].alias("start"), acc["end"].alias("end")))).alias("out"),
            s["start"].alias("start"), s["end"].alias("end"))).otherwise(F.struct(
                acc["out"].alias("out"), acc["start"].alias("start"), end.alias("end")))

    none = F.lit(None).cast("long")
    kept = F.aggregate(
        spans, F.struct(F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"),
                        none.alias("start"), none.alias("end")), step,
        lambda acc: F.concat(acc["out"], F.array(F.struct(
            acc["start"].alias("start"), acc["end"].alias("end")))))
    # The first entry is the empty start of the fold.
    return bound(kept, lambda x: F.transform(F.slice(x, F.lit(2), F.size(x) - 1), lambda s, i: F.struct(
        s["start"].alias("start"), s["end"].alias("end"),
        F.coalesce(F.get(x, i)["end"], F.lit(0).cast("long")).alias("before"))))


def replaced(text: Column, spans: Column, by: Callable[[Column], Column]) -> Column:
    """The text with ``by(span)`` for each of the joined spans."""
    return bound(F.struct(stretches(text).alias("parts"), joined(spans).alias("spans")), lambda x: F.concat(
        F.array_join(F.transform(x["spans"], lambda s: F.concat(
            between(x["parts"], s["before"], s["start"]), by(s))), ""),
        between(x["parts"], F.element_at(x["spans"], -1)["end"], F.length(text).cast("long"))))


def without(text: Column, spans: Column) -> Column:
    """The text with ``TAKEN`` for each character in a span, or null without spans."""
    return F.when(F.size(spans) > 0, replaced(text, spans, lambda s: F.repeat(
        F.lit(TAKEN), (s["end"] - s["start"]).cast("int"))))


def scanned(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``base`` and ``spans``: sorted arrays of (start, kind, end)."""
    names = ("assign", "access", "hex", "candidate")
    for name, pattern in zip(names, (ASSIGN, ACCESS, HEX, CANDIDATE)):
        rows = cut(rows, text, f"_{name}", pattern)
    value = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(ASSIGN), F.lit(1))
    rows = rows.withColumn("_assign_value", F.when(F.col("_assign_any"), value))

    def matches(kind: int) -> Column:
        name = f"_{KINDS[kind]}"
        return F.transform(
            F.arrays_zip(F.col(f"{name}_start").alias("s"), F.col(f"{name}_match").alias("m")),
            lambda z: span(kind, z["s"], z["s"] + F.length(z["m"])))

    long_enough = F.transform(
        F.filter(F.arrays_zip(F.col("_assign_start").alias("s"), F.col("_assign_match").alias("m"),
                              F.col("_assign_value").alias("v")),
                 lambda z: F.length(z["v"]) >= SHORTEST_VALUE),
        lambda z: span(0, z["s"], z["s"] + F.length(z["m"])))
    none = F.array().cast(SPANS)
    base = F.array_sort(F.concat(F.coalesce(long_enough, none), F.coalesce(matches(1), none),
                                 F.coalesce(matches(2), none)))
    rows = rows.withColumn("base", base)
    rows = rows.withColumn("_hot", hot_spans("_candidate", allowed))
    apart = F.filter("_hot", lambda e: ~F.exists("base", lambda b: (
        (b["start"] < e["end"]) & (e["start"] < b["end"]))))
    # A stretch that is apart is found once more in the rest, and kept once.
    rows = cut(rows.withColumn("_left", without(F.col(f"`{text}`"), F.col("base"))),
               "_left", "_rest", REST)
    rest = hot_spans("_rest", lambda m: allowed(m) | allowed(
        F.regexp_replace(m, LEADING, "")))
    rows = rows.withColumn("_entropy", F.array_distinct(F.concat(
        F.coalesce(apart, none), F.coalesce(rest, none))))
    return rows.withColumn("spans", F.array_sort(F.concat("base", "_entropy")))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans: arrays of (start, kind, end), kind a position in
    ``KINDS``."""
    rows = scanned(frames.keyed_texts(docs, id_col, text_col))
    return rows.select("doc_id", "base", "spans")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """Counts by kind, digest of the fixed patterns' spans, all spans."""
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, text_col: str = "text", marker: str = "<secret>") -> DataFrame:
    """``docs`` with every span replaced by ``marker``, all rows and columns kept.

    Spans that overlap or touch are replaced together; a text without spans is
    unchanged.
    """
    keep = [c for c in docs.columns]
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
                        F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = scanned(inner).select("row", "text", "spans")
    step = replaced(F.col("text"), F.col("spans"), lambda s: F.lit(marker))
    rows = rows.withColumn("text", F.when(F.size("spans") > 0, step).otherwise(F.col("text")))
    return rows.select(*[
        F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in keep])
