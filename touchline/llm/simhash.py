"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within distance 4 have a common variant within distance 2 of
both, and two that share such a variant are within distance 4 by the triangle
inequality.  So every distinct fingerprint stands for the ball of all its
variants within ``RADIUS // 2``, and those sharing a variant are linked: to the
least of them, which loses no connection and never writes out pairs.

The shuffle is on the leading bits of the variants (16, or more for many
fingerprints).  A fingerprint travels once to each value of those bits that a
variant of it has (137 for 16 bits), not once for each of its 2,081 variants; the variants themselves are made next to
the others of their bucket, sorted in blocks of bounded size, and colliding
fingerprints are merged there, so that a block gives at most one link for each
fingerprint.  Buckets with more than ``CROWDED`` fingerprints are dealt again
on eight more bits, as often as needed (at 64 bits a bucket is one variant, and
a grouped minimum links it), so no task holds a large group.

Classes of linked fingerprints come from the large-star / small-star iteration
with grouped minima and joins, staged in the shared folder after each round.

Distinct fingerprints are classed, and documents get their class last, so that
neither many copies of a text nor a class of many texts lands in one task.

Defined results: a null text has no words; a text without words has the
fingerprint zero and is linked like any other; repeated rows are in one class, and
of rows equal in every column one stays;
a class whose ids are all null has a null component_id; an empty table gives an
empty result.  Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm import frames, words as w

SHINGLE = 4
RADIUS = 4
FIRST_BITS, MORE_BITS = 16, 8
#: Fingerprints a bucket may have before it is dealt on more bits (each has about
#: a thousand variants in it, all in memory at once).
CROWDED = 2_000
#: Variants sorted at once in a task.
BLOCK = 1 << 20
SEED = 42
#: Copies of a class's value, and how many rows make a fingerprint common: one of so
#: many (so there are no more of them).
SALT, COMMON = 16, 1_000


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """A bit is one if more than half of the shingles' XXH64 have it."""
    found = w.spaced_words(text.lower())
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= size:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-size])).tolist()
    ends = (ends[size - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends)),
                    np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at:at + (1 << 16)].astype("<u8").view(np.uint8)
        ones += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry``, text_key (hash of the text), fp (64 bits as a long)."""
    def work(batch):
        bodies = frames.texts(batch)
        return {"text_key": [signed(xxhash.xxh3_64_intdigest(b)) for b in bodies],
                "fp": [signed(fingerprint(b)) for b in bodies]}

    return frames.arrow_map(docs, work, "text_key long, fp long", carry)


def masks(first: int, last: int, radius: int) -> list[int]:
    """Every pattern of at most ``radius`` ones among the bits first..last-1,
    counted from the top of 64."""
    bits = [1 << (63 - i) for i in range(first, last)]
    return [sum(c) for r in range(radius + 1) for c in combinations(bits, r)]


def bucket_links(rows: DataFrame, bits: int) -> DataFrame:
    """Links inside the buckets of a frame with bucket, fp, sorted by bucket."""
    half = RADIUS // 2
    flips = masks(bits, 64, half)
    counts = [len(masks(bits, 64, r)) for r in range(half + 1)]

    def work(batches):
        flip = np.array(flips, np.uint64)
        by_distance = np.array([*counts[::-1], *[0] * 64])
        held_b, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)

        def links(bucket, fp):
            """Whole buckets, in blocks of about BLOCK variants."""
            if not len(bucket):
                return
            order = np.lexsort((fp, bucket))
            bucket, fp = bucket[order], fp[order]
            prefix = fp >> np.uint64(64 - bits)
            near = bitcount(prefix ^ bucket.astype(np.uint64))
            # The variant inside the bucket that differs in no later bit.
            low = fp & np.uint64((1 << (64 - bits)) - 1)
            center = low | (bucket.astype(np.uint64) << np.uint64(64 - bits))
            sizes = by_distance[near]
            edge = np.flatnonzero(np.concatenate((bucket[1:] != bucket[:-1], [True]))) + 1
            total = np.cumsum(sizes)[edge - 1]
            at = done = 0
            while at < len(bucket):
                last = max(np.searchsorted(total, done + BLOCK, "right"), 1)
                end = int(edge[min(last, len(edge)) - 1])
                if end <= at:
                    end = int(edge[np.searchsorted(edge, at, "right")])
                yield from block(fp[at:end], center[at:end], sizes[at:end])
                at, done = end, int(total[np.searchsorted(edge, end)])

        def block(fp, center, sizes):
            # A fingerprint comes up once a bucket: merge by distinct value.
            value, of = np.unique(fp, return_inverse=True)
            member, least = spread(center, sizes, of, len(value))
            if len(member):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value[member].view(np.int64)),
                     pa.array(value[least].view(np.int64))], ["a", "b"])

        def spread(center, sizes, of, n):
            owner = np.repeat(np.arange(len(center)), sizes)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            return linked(center[owner] ^ flip[nth], of[owner], n)

        for batch in batches:
            bucket = np.concatenate((held_b, batch.column(0).to_numpy(zero_copy_only=False)))
            fp = np.concatenate((
                held_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            keep = int(np.searchsorted(bucket, bucket[-1])) if len(bucket) else 0
            yield from links(bucket[:keep], fp[:keep])
            held_b, held_f = bucket[keep:], fp[keep:]
        yield from links(held_b, held_f)

    return rows.mapInArrow(work, "a long, b long")


def bitcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def linked(variant: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ``n`` owners, those merged with a lesser one, and the least of theirs.

    Owners of equal variants are merged.
    """
    order = np.argsort(variant)
    variant, owner = variant[order], owner[order]
    same = variant[1:] == variant[:-1]
    touched = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    variant, owner = variant[touched[:len(variant)]], owner[touched[:len(owner)]]
    if not len(owner):
        return owner, owner
    starts = np.concatenate(([True], variant[1:] != variant[:-1]))
    first, group = np.flatnonzero(starts), np.cumsum(starts) - 1
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, owner, np.minimum.reduceat(label[owner], first)[group])
        new = new[new]
        if (new == label).all():
            break
        label = new
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


def dealt(rows: DataFrame, bits: int, more: int) -> DataFrame:
    """Deal rows on ``more`` further bits: one row for each bucket that has a
    variant of the fingerprint."""
    half = RADIUS // 2
    patterns = [m >> (64 - bits - more) for m in masks(bits, bits + more, half)]
    low = (1 << more) - 1
    prefix = F.shiftrightunsigned("fp", 64 - bits - more) if bits + more < 64 else F.col("fp")
    options = F.array(*[F.lit(p).cast("long") for p in patterns])
    spent = (F.bit_count(F.shiftrightunsigned("fp", 64 - bits).bitwiseXOR(F.col("bucket")))
             if bits else F.lit(0))
    start = (F.shiftleft("bucket", more).bitwiseOR(prefix.bitwiseAND(F.lit(low)))
             if bits else prefix)
    return (
        rows.withColumn("_spent", spent)
        .withColumn("_flip", F.explode(options))
        .filter(F.col("_spent") + F.bit_count("_flip") <= half)
        .select(start.bitwiseXOR(F.col("_flip")).alias("bucket"), "fp")
    )


def first_bits(count: int, crowded: int) -> int:
    """So many leading bits that an average bucket is far from crowded."""
    for bits in range(FIRST_BITS, 40, MORE_BITS):
        if count * len(masks(0, bits, RADIUS // 2)) <= crowded / 2 * (1 << bits):
            return bits
    return 40


def links(distinct: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Connecting links (a > b) among distinct fingerprints within RADIUS."""
    found, rows, bits = [], distinct.withColumn("bucket", F.lit(0).cast("long")), 0
    more = first_bits(distinct.count(), crowded)
    while True:
        rows, bits = dealt(rows, bits, more), bits + more
        if bits == 64:
            least = rows.groupBy("bucket").agg(F.min("fp").alias("b"))
            found.append(rows.join(least, "bucket").filter("fp <> b")
                         .select(F.col("fp").alias("a"), "b"))
            break
        full = frames.staged(rows.groupBy("bucket").count()
                             .filter(F.col("count") > crowded).select("bucket"))
        any_full = not full.isEmpty()
        calm = rows.join(full, "bucket", "left_anti") if any_full else rows
        found.append(bucket_links(
            calm.repartition("bucket").sortWithinPartitions("bucket"), bits))
        if not any_full:
            break
        rows, more = rows.join(full, "bucket", "left_semi"), min(MORE_BITS, 64 - bits)
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of every linked node's component."""
    edges = frames.staged(edges)
    while True:
        # Large star: every larger neighbour goes to the least one around.
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (both.filter("b > a").join(least, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # Small star: every smaller neighbour, and the node, go to the least one.
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small_least, "a")
        small = (joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(small_least.select("a", F.col("m").alias("b"))).distinct())
        after = frames.staged(small)
        # Done when the graph is made of stars: no node is both child and root.
        if after.select("a").join(after.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            if after.groupBy("a").count().filter("count > 1").isEmpty():
                return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = after


def linked_fingerprints(marked: DataFrame, crowded: int) -> tuple[DataFrame, DataFrame]:
    """fp and its class (root), for every distinct fingerprint; and the table of them
    with their number of rows."""
    prints = frames.staged(marked.groupBy("fp").agg(F.count(F.lit(1)).alias("rows")))
    roots = components(links(prints.select("fp"), crowded))
    found = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"))
    return found, prints


def by_class(found: DataFrame, values: DataFrame, least: Column, name: str) -> DataFrame:
    """fp and ``name``: the least value of its class.

    ``values`` has a row for each fingerprint, so copies are already one.  A class
    may have very many fingerprints: its least value is copied ``SALT`` times.
    """
    rows = found.join(values, "fp")
    salt = F.pmod(F.xxhash64("fp"), F.lit(SALT))
    best = rows.groupBy("root").agg(F.min(least).alias(name))
    copies = best.withColumn("salt", F.explode(
        F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    return (rows.select("fp", "root", salt.alias("salt"))
            .join(copies, ["root", "salt"]).select("fp", name))


def to_rows(marked: DataFrame, prints: DataFrame, values: DataFrame) -> DataFrame:
    """The rows with their fingerprint's values.

    Fingerprints of a thousandth of all rows (a thousand at most) are broadcast, so
    that no task joins all rows of one.
    """
    total = prints.agg(F.sum("rows")).first()[0] or 0
    common = F.broadcast(values.join(
        F.broadcast(prints.filter(F.col("rows") * COMMON > total).select("fp")), "fp", "left_semi"))
    rest = marked.join(common.select("fp"), "fp", "left_anti").join(values, "fp")
    return rest.unionByName(marked.join(common, "fp").select(*rest.columns))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    crowded: int = CROWDED) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    marked = frames.staged(fingerprints(frames.keyed_texts(docs, id_col, text_col)))
    found, prints = linked_fingerprints(marked, crowded)
    ids = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    names = frames.staged(by_class(found, ids, F.col("least"), "component_id"))
    return to_rows(marked, prints, names).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """One row of each class, all its columns unchanged: the least doc_id (nulls
    last); among rows of one id the least hash of the text, then of the whole row."""
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), frames.row_hash(docs).alias("row"))
    marked = frames.staged(fingerprints(
        docs.select(key.alias("key"), F.col("text").cast("string").alias("text")), ("key",)))
    found, prints = linked_fingerprints(marked, crowded)
    order = F.struct(F.col("key.doc_id").isNull().alias("n"), F.col("key.doc_id").alias("doc_id"),
                     "text_key", "key")
    firsts = marked.groupBy("fp").agg(F.min(order).alias("first"))
    kept = frames.staged(by_class(found, firsts, F.col("first"), "kept")
                         .select(F.col("kept.key").alias("key")).distinct())
    times = frames.staged(marked.groupBy("key").agg(F.count(F.lit(1)).alias("times")))
    lost = frames.staged(times.join(kept, "key", "left_anti").select("key"))
    twice = times.filter("times > 1").join(kept, "key", "left_semi").select("key")
    return frames.without(docs, key, lost, frames.staged(twice))
