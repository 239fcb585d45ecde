"""Quality rules: fixed rules, then a hashed n-gram log-likelihood ratio.

Every run of ``GRAM`` bytes of a text (words joined by one space) falls into one
of ``BUCKETS`` hash buckets.  Two multinomials over the buckets are estimated:
the raw corpus (all documents) and the trusted target (labelled documents).  A
document's score is its log-likelihood ratio, target against raw, per n-gram.
Documents below a threshold are rejected: the ``QUANTILE`` of the scores of
trusted documents that the target has not seen, less ``MARGIN``.

The counts are made inside the tasks (a few rows a task with the counts of all
buckets are shuffled), so n-grams do not move; the model has ``BUCKETS`` numbers whatever the
corpus, and is what is broadcast.  The raw counts come from a plain scan.  All
trusted documents count: by the hash of their id, a fifth sets the threshold and the
others the target.  A scan passes on only documents whose id is in a bitmap of the
trusted ids (4 MB whatever their number), and those are joined to the
ids, always by a sort-merge join, so that the plan is one at all sizes and only
trusted texts (and what the bitmap lets through besides) are shuffled.  The held-out scores
are staged and their quantile found by counts in ever narrower ranges, so that it is
exact and no more than ``FEW`` scores are gathered.  The same tables always give the
same verdicts; a document whose score is the threshold stays.

Defined results: a null or empty text has no words and fails the base rules; a
document without n-grams scores 0; each repeated row is counted and judged; an
empty table gives an empty result; without any trusted row every score is 0, so
that the base rules alone decide.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import frames, words as w

BITS = 16
BUCKETS = 1 << BITS
#: One of so many trusted documents sets the threshold.
PARTS = 5
#: Scores that the driver sorts, and ranges that more of them are counted in.
FEW = 10_000
RANGES = 1_000
#: Smoothing: pseudo-counts per bucket, in the proportions of the raw corpus.
PRIOR = 0.5
QUANTILE = 0.005
#: Nats per n-gram that a document may lie below that quantile.
MARGIN = 0.1
#: Bytes in an n-gram, and bytes of a text that are worked on at once.
GRAM = 5
PIECE = 1 << 20
#: Pieces that are counted together, and slices that the buckets are added up in.
HELD, SLICES = 64, 16
WINDOW = 8
SYMBOLS = b"#*$%&|<>"

COLUMNS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, "
           "n_repeat_words long, base_failed boolean, kept boolean, score double")


def grams(found: list[bytes]) -> Iterator[np.ndarray]:
    """Buckets of a text's n-grams, a bounded piece at a time."""
    line = np.frombuffer(b" ".join(found), np.uint8)
    for at in range(0, len(line) - GRAM + 1, PIECE):
        piece = line[at:at + PIECE + GRAM - 1].astype(np.uint64)
        size = len(piece) - GRAM + 1
        value = piece[:size].copy()
        for k in range(1, GRAM):
            value <<= np.uint64(8)
            value |= piece[k:k + size]
        yield ((value * np.uint64(w.BASE)) >> np.uint64(64 - BITS)).astype(np.int64)


def score_of(found: list[bytes], ratios: np.ndarray) -> float:
    """Mean log ratio of the n-grams."""
    total = number = 0
    for bucket in grams(found):
        total, number = total + ratios[bucket].sum(), number + len(bucket)
    return float(total / number) if number else 0.0


def repeated_words(found: list[bytes]) -> int:
    """Words inside windows that occur twice or more in the text."""
    h = w.rolling(w.hashes(found), WINDOW)
    if not len(h):
        return 0
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twin = np.zeros(len(h), bool)
    twin[order[1:]] |= same
    twin[order[:-1]] |= same
    at = np.flatnonzero(twin)
    if not len(at):
        return 0
    seen = [tuple(found[i:i + WINDOW]) for i in at]
    times = Counter(seen)
    exact = at[np.fromiter((times[s] > 1 for s in seen), bool, len(seen))]
    return int(w.covered(exact, WINDOW, len(found)).sum())


def measures(text: bytes, found: list[bytes]) -> tuple[int, int, int, int, int, bool]:
    lines = [x for x in text.split(b"\n") if x.strip()]
    n, repeats = len(found), repeated_words(found)
    return (n, w.code_points(b"".join(found)), len(text) - len(text.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeats, n < 20 or 100 * repeats > 30 * n)


def trusted(labels: DataFrame) -> DataFrame:
    """doc_id of all documents labelled good and harmless, and whether they are
    held out for the threshold."""
    good = (labels.filter("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL")
            .select(F.col("doc_id").cast("long").alias("doc_id")).distinct())
    return good.withColumn("held_out", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)) == 0)


def trusted_ids(labels: DataFrame) -> tuple[list[int], list[int]]:
    """Ids of the target and of the held-out documents (for small tables)."""
    rows = trusted(labels).collect()
    return [r[0] for r in rows if not r[1]], [r[0] for r in rows if r[1]]


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and held_out (null where a document is not trusted) of every row (for
    small tables: it moves all texts)."""
    # Rows without an id match nothing; their texts spread them.
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    left = docs.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), "text",
                       F.col("doc_id").isNull().alias("no_id"), spread.alias("spread"))
    right = trusted(labels).withColumns({"no_id": F.lit(False), "spread": F.lit(0).cast("long")})
    return left.join(right, ["doc_id", "no_id", "spread"], "left").select("text", "held_out")


def trusted_texts(docs: DataFrame, labels: DataFrame, held_out: bool) -> DataFrame:
    """text of every row whose document is trusted, of one of the two parts."""
    ids = trusted(labels).filter(F.col("held_out") == held_out).select("doc_id")
    known = frames.key_bitmap(ids.select(F.xxhash64("doc_id").alias("hash")))
    rows = frames.with_bit(docs.select("doc_id", "text").filter("doc_id IS NOT NULL"),
                           F.xxhash64("doc_id"), known, "_likely").filter("_likely")
    return rows.join(ids.hint("merge"), "doc_id", "left_semi").select("text")


def log_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw), for every bucket."""
    size = BUCKETS

    def count(batches):
        total, held = np.zeros(size, np.int64), []
        for batch in frames.slices(batches):
            for text in frames.texts(batch):
                for bucket in grams(w.spaced_words(text)):
                    held.append(bucket.astype(np.uint16))
                    if len(held) == HELD:
                        total += np.bincount(np.concatenate(held), minlength=size)
                        held = []
        if held:
            total += np.bincount(np.concatenate(held), minlength=size)
        yield sliced(range(SLICES), np.split(total, SLICES))

    def sliced(numbers, counts):
        return pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int32()), pa.array([c.tobytes() for c in counts], pa.binary())],
            ["slice", "n"])

    def add(batches):
        sums = {}
        for batch in batches:
            for number, n in zip(*(c.to_pylist() for c in batch.columns)):
                sums[number] = sums.get(number, 0) + np.frombuffer(n, np.int64)
        if sums:
            yield sliced(list(sums), sums.values())

    def counted(texts: DataFrame) -> np.ndarray:
        # A few rows a task: the buckets in slices, each added up by one task.
        parts = texts.mapInArrow(count, "slice int, n binary").repartition("slice")
        out = np.zeros((SLICES, size // SLICES))
        for number, n in parts.mapInArrow(add, "slice int, n binary").collect():
            out[number] = np.frombuffer(n, np.int64)
        return out.ravel()

    raw = counted(docs.select("text"))
    target = counted(trusted_texts(docs, labels, held_out=False))
    if not target.sum():
        return np.zeros(size)
    p = (raw + PRIOR) / (raw.sum() + PRIOR * size)
    q = (target + PRIOR * size * p) / (target.sum() + PRIOR * size)
    return np.log(q) - np.log(p)


def low_quantile(scores: DataFrame) -> float | None:
    """The ``QUANTILE`` of column ``score`` (the lower of two), or null if empty."""
    ends = F.count("score"), F.min("score"), F.max("score")
    n, low, high = scores.agg(*ends).first()
    if not n:
        return None
    # The wanted score is the one at ``place`` among the n from low to high.
    place = math.floor(QUANTILE * (n - 1))
    while n > FEW and low < high:
        at = F.least(F.lit(RANGES - 1), F.floor(
            (F.col("score") - low) / (high - low) * RANGES)).cast("int")
        rows = scores.filter(F.col("score").between(low, high)).groupBy(at.alias("at")).agg(*ends)
        for _, n, low, high in sorted(map(tuple, rows.collect())):
            if place < n:
                break
            place -= n
    if low == high:
        return low
    few = scores.filter(F.col("score").between(low, high)).collect()
    return sorted(r[0] for r in few)[place]


def threshold_of(docs: DataFrame, labels: DataFrame, ratios: np.ndarray) -> float:
    """The low quantile of the held-out documents' scores (20 words or more)."""
    model = docs.sparkSession.sparkContext.broadcast(ratios)

    def work(batch):
        found = [w.spaced_words(t) for t in frames.texts(batch)]
        return {"score": [score_of(x, model.value) if len(x) >= 20 else None for x in found]}

    picked = trusted_texts(docs, labels, held_out=True)
    scores = frames.arrow_map(picked, work, "score double").filter("score IS NOT NULL")
    limit = low_quantile(frames.staged(scores))
    return -np.inf if limit is None else limit - MARGIN


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The model: log ratios by bucket, and the threshold."""
    ratios = log_ratios(docs, labels)
    return ratios, threshold_of(docs, labels, ratios)


def judge(docs: DataFrame, ratios: np.ndarray, threshold: float,
          carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The measures and the verdict for every row, next to the ``carry`` columns."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    model = docs.sparkSession.sparkContext.broadcast(ratios)

    def work(batch):
        out = []
        for body in frames.texts(batch):
            found = w.spaced_words(body)
            got = measures(body, found)
            score = score_of(found, model.value)
            out.append((*got, not got[-1] and score >= threshold, score))
        return dict(zip(names, zip(*out)))

    return frames.arrow_map(docs, work, COLUMNS, carry)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the five counts, base_failed, kept, score."""
    rows = frames.keyed_texts(docs, id_col, text_col)
    return judge(rows, *fitted(rows, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, all their columns unchanged."""
    ratios, threshold = fitted(frames.keyed_texts(docs, "doc_id", "text"), labels)
    key = frames.text_key(docs)
    judged = judge(docs.select(key.alias("key"), F.col("text").cast("string").alias("text")),
                   ratios, threshold, carry=("key",))
    lost = frames.staged(judged.filter(~F.col("kept")).select("key").distinct())
    return frames.without(docs, key, lost)
