"""Personal data: fixed patterns, then bootstrapped contextual extraction.

The fixed patterns (email, ip, card, phone) give the seeds.  Every other token with
a digit (``SHORTEST`` to ``LONGEST`` characters) is a possible entity.  A lexical
pattern is a context with the value's shape (runs of digits and letters): the word
before, the two words before, or the words before and after.  Patterns and instances
(values) form a bipartite graph over the whole corpus.

A pattern's confidence is the summed confidence of what stands there, over *every*
occurrence of its context in the corpus, whatever follows: a context that is mostly
followed by other words can never be trusted.  Such patterns (and those with fewer
than ``SUPPORT`` distinct values) leave the graph at once; a second scan counts the
contexts of the others, found by a bitmap of their hashes (4 MB).  Spark scores the
graph in ``ROUNDS`` rounds: an instance has the highest confidence of its patterns
that have at least ``SUPPORT`` confident instances; seeds stay at 1.  Tokens in a
pattern whose final confidence reaches ``ACCEPT`` are found as ``context`` spans.
Confidences are whole millionths, so results do not depend on the order of sums.

Only spans, hashes of values and patterns leave the first scan, only counts the
second; graph edges are combined before each shuffle.

Defined results: a null or empty text has no spans; positions count code
points, end exclusive; repeated rows are each reported, and each counts; words of a
context are whole, however long; an entity that starts inside a token (after more
than punctuation) has no pattern; an empty table gives an empty result.  Other
columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm import frames, words as w
from touchline.llm.simhash import signed

KINDS = ("email", "ip", "card", "phone", "context")

# The patterns.  A look-behind keeps a match from starting inside
# a run of digits, where one could only start if the run's first digit failed;
# email is anchored at its sign.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
SPACE = frozenset(" \t\n\x0b\x0c\r")

SHORTEST, LONGEST = 4, 64
ROUNDS = 3
SUPPORT = 5
ONE = 1_000_000
ACCEPT = 800_000

_TRIM = ".,;:!?\"'()[]{}<>"
_DIGITS = str.maketrans("0123456789", "##########")
_BLANK = bytes(32 if b in b" \t\n\x0b\x0c\r" else b for b in range(256))
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Before the first and after the last word of a text.
BEGIN, END = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"\x00^", b"\x00$"))


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((start, end))
        at = text.find("@", found.end() if found else at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted."""
    out = [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255
                   for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def tokens(text: str) -> list[tuple[int, int]]:
    """Tokens with a digit, without punctuation around them."""
    out, at = [], DIGIT.search(text)
    while at:
        start = end = at.start()
        while start and end - start <= LONGEST and text[start - 1] not in SPACE:
            start -= 1
        while end < len(text) and text[end] not in SPACE:
            end += 1
        a, b = start, end
        while a < b and text[a] in _TRIM:
            a += 1
        while b > a and text[b - 1] in _TRIM:
            b -= 1
        if SHORTEST <= b - a <= LONGEST and (not start or text[start - 1] in SPACE):
            out.append((a, b))
        at = DIGIT.search(text, end)
    return out


def normal(word: str) -> str:
    return word.strip(_TRIM).lower().translate(_DIGITS)


def word_hash(word: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(normal(word).encode()))


def shape(value: str) -> str:
    """Runs of digits as 9, of letters as a, other characters as they are."""
    return re.sub("a+", "a", re.sub("9+", "9", "".join(
        "9" if "0" <= c <= "9" else "a" if c.isalpha() else c for c in value)))


def context_hashes(far: np.ndarray, near: np.ndarray, after: np.ndarray) -> list[np.ndarray]:
    """Hashes of the three contexts of places between words: the word before, the two
    words before, the words before and after."""
    base = np.uint64(w.BASE)
    one, two, three = (w.mix(near + np.uint64(k)) for k in (1, 2, 3))
    return [one, w.mix(two * base + far), w.mix(three * base + after)]


def patterns(text: str, spans: list[tuple[int, int]], begins: list[int], start: int,
             end: int) -> list[dict]:
    """The patterns of a value: hash of the context, and its words with the shape."""
    i, j = bisect_right(begins, start) - 1, bisect_right(begins, end - 1) - 1
    if text[spans[i][0]:start].strip(_TRIM):
        return []
    around = [text[slice(*spans[k])] if 0 <= k < len(spans) else None for k in (i - 2, i - 1, j + 1)]
    far, near, after = (word_hash(x) if x is not None else edge
                        for x, edge in zip(around, (BEGIN, BEGIN, END)))
    hashes = context_hashes(*(np.array([x]) for x in (far, near, after)))
    f, n, a = ("^" if x is None else normal(x) for x in around)
    kind = shape(text[start:end])
    names = [f"{n} _ |{kind}", f"{f} {n} _ |{kind}", f"{n} _ {a} |{kind}"]
    # What stands over several words has its neighbour further than a place's.
    return [{"context": signed(int(h[0])), "pattern": x} for h, x in zip(hashes, names)][:3 if i == j else 2]


def entities(text: str):
    """Base spans, and every instance: start, end, seed, value, patterns."""
    if "@" not in text and not DIGIT.search(text):
        return [], []
    base, found, at = base_spans(text), [], 0
    for a, b in tokens(text):
        while at < len(base) and base[at][2] <= a:
            at += 1
        if not any(s < b and a < e for s, _, e in base[at:at + 8]):
            found.append((a, b, False))
    found += [(a, b, True) for a, b in sorted({(a, b) for a, _, b in base})]
    spans = [m.span() for m in WORD.finditer(text)] if found else []
    begins = [a for a, _ in spans]
    return ([{"start": a, "kind": k, "end": b} for a, k, b in base],
            [{"start": a, "end": b, "seed": s, "patterns": patterns(text, spans, begins, a, b),
              "value": signed(xxhash.xxh3_64_intdigest(text[a:b].lower().encode()))}
             for a, b, s in found])


FOUND = ("text_key long, base array<struct<start:long,kind:int,end:long>>, instances "
         "array<struct<start:long,end:long,seed:boolean,"
         "patterns:array<struct<context:long,pattern:string>>,value:long>>")


def read(docs: DataFrame) -> DataFrame:
    def work(batch):
        bodies = frames.texts(batch)
        both = [entities(b.decode("utf-8", "replace")) for b in bodies]
        return {"text_key": [signed(xxhash.xxh3_64_intdigest(b)) for b in bodies],
                "base": [x[0] for x in both], "instances": [x[1] for x in both]}

    return frames.staged(frames.arrow_map(docs, work, FOUND, ("doc_id",)))


def occurrences(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """context, n: how often the contexts (and others with their bits) occur."""
    bit = F.col("context").bitwiseAND(F.lit(frames.KEY_BITS - 1))
    known = docs.sparkSession.sparkContext.broadcast(frames.bitmap(contexts.select(
        F.shiftright(bit, 6).alias("word"),
        F.expr("shiftleft(1L, cast(context & 63 AS int))").alias("mask")), frames.KEY_BITS))

    def count(batches):
        for batch in frames.slices(batches):
            bodies = pa.array([t.translate(_BLANK) for t in frames.texts(batch)], pa.large_binary())
            split = pc.split_pattern(bodies, " ")
            coded = split.flatten().cast(pa.binary()).dictionary_encode()
            hashes = np.array([word_hash(x.decode("utf-8", "replace"))
                               for x in coded.dictionary.to_pylist()], np.uint64)
            full = np.array([len(x) > 0 for x in coded.dictionary.to_pylist()], bool)
            code = coded.indices.to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(bodies)), split.value_lengths().to_numpy(zero_copy_only=False))
            if not len(code):
                continue
            keep = full[code]
            code, row = code[keep], row[keep]
            h = hashes[code]
            same = row[1:] == row[:-1]
            near = np.concatenate(([BEGIN], np.where(same, h[:-1], BEGIN)))[:len(h)]
            far = np.concatenate(([BEGIN], np.where(same, near[:-1], BEGIN)))[:len(h)]
            after = np.concatenate((np.where(same, h[1:], END), [END]))[:len(h)]
            every = np.concatenate(context_hashes(far, near, after))
            value, n = np.unique(every[frames.has_bits(known.value, every)], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(value.view(np.int64)), pa.array(n)], ["context", "n"])

    return (docs.select("text").mapInArrow(count, "context long, n long")
            .groupBy("context").agg(F.sum("n").alias("n")))


def graph(found: DataFrame, docs: DataFrame, support: int, accept: int) -> DataFrame:
    """pattern, n, value, times, seed: the edges of patterns that can be trusted at all."""
    edges = frames.staged(
        found.select(F.explode("instances").alias("i"))
        .select("i.value", "i.seed", F.explode("i.patterns").alias("pattern"))
        .groupBy("pattern", "value").agg(
            F.max("seed").alias("seed"), F.count(F.lit(1)).alias("times")))
    wanted = frames.staged(
        edges.groupBy("pattern").agg(
            F.sum("times").alias("all"), F.count(F.lit(1)).alias("values"))
        .filter(F.col("values") >= support).withColumn("context", F.col("pattern.context")))
    able = (wanted.join(occurrences(docs, wanted), "context")
            .filter(F.col("all") * ONE >= F.col("n") * accept).select("pattern", "n"))
    return frames.staged(edges.join(able, "pattern"))


def accepted_patterns(edges: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT,
                      accept: int = ACCEPT) -> DataFrame:
    """pattern, confidence: the scored graph's trusted patterns."""
    seeds = edges.filter("seed").select("value").distinct()
    known = seeds.withColumn("confidence", F.lit(ONE).cast("long"))
    for turn in range(rounds):
        scored = edges.join(known, "value", "left")
        trusted = frames.staged(
            scored.groupBy("pattern").agg(
                F.least(F.expr("sum(times * coalesce(confidence, 0)) div max(n)"),
                        F.lit(ONE).cast("long")).alias("confidence"),
                F.count_if(F.col("confidence") >= accept).alias("support"))
            .filter((F.col("support") >= support) & (F.col("confidence") > 0))
            .select("pattern", "confidence"))
        if turn == rounds - 1:
            return trusted.filter(F.col("confidence") >= accept)
        best = edges.join(trusted, "pattern").groupBy("value").agg(
            F.max("confidence").alias("confidence"))
        known = frames.staged(
            best.join(seeds, "value", "left_anti")
            .unionByName(seeds.withColumn("confidence", F.lit(ONE).cast("long"))))
    raise ValueError("rounds must be positive")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       rounds: int = ROUNDS, support: int = SUPPORT,
                       accept: int = ACCEPT) -> DataFrame:
    """doc_id, base and spans: sorted arrays of (start, kind, end), kind a
    position in ``KINDS``."""
    rows = frames.keyed_texts(docs, id_col, text_col)
    found = read(rows)
    trusted = accepted_patterns(graph(found, rows, support, accept), rounds, support, accept)
    row = F.struct(F.col("doc_id").alias("d"), F.col("text_key").alias("t")).alias("row")
    new = (
        found.select(row, F.explode("instances").alias("i")).filter(~F.col("i.seed"))
        .select("row", "i.start", "i.end", F.explode("i.patterns").alias("pattern"))
        .join(trusted, "pattern", "left_semi")
        .groupBy("row").agg(F.collect_set(F.struct(
            "start", F.lit(KINDS.index("context")).alias("kind"), "end")).alias("more")))
    none = F.array().cast("array<struct<start:long,kind:int,end:long>>")
    return (found.select("doc_id", "base", row).join(new, "row", "left")
            .select("doc_id", "base",
                    F.array_sort(F.concat("base", F.coalesce("more", none))).alias("spans")))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"))
