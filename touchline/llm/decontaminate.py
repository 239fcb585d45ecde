"""Benchmark decontamination as a prefix-filtered containment join.

Every item gives windows of ``WINDOW`` consecutive words.  A window stands for
the set of its word shingles, ordered by rarity: by how often the whole corpus
has them, rarest first.  Containment needs all of them, so the necessary prefix
of a window is its one rarest shingle, and only that is joined with the
documents' shingles; windows whose rarest shingle occurs nowhere drop out.  A
match fixes where the window would have to lie: it must start at or after the
document's first word and end by the last one (positional and length bounds).
What is left is compared word by word.

The items travel to the documents, which are neither moved nor exploded.  Items
are broadcast in blocks of at most ``BLOCK_BYTES`` of their text (checked by a
sum before); a larger benchmark takes several passes, whose hits are merged by
document.

Defined results: a null or wordless text has no words, hits or items; a
wordless or null item has no window; a null item_id counts as the item "null";
equal items are all reported; every repeated row is judged; empty tables give
no rows (no documents) or no hits (no items).  Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import frames, words as w

WINDOW = 13
SHINGLE = 3
#: Text of the items that is broadcast at once.
BLOCK_BYTES = 4 << 20
#: Bits of the table that tells most document shingles apart from all prefixes.
FILTER_BITS = 22

FOUND = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def items_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """line (an item's words, space-joined), ids (of all items with these words)."""
    rows = benchmark.select(
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("id"),
        F.col(f"`{text_col}`").cast("string").alias("text"))
    lines = frames.arrow_map(
        rows, lambda b: {"line": [b" ".join(w.plain_words(t)).decode("utf-8", "replace")
                                  for t in frames.texts(b)]}, "line string", ("id",))
    return (lines.filter("line <> ''").groupBy("line")
            .agg(F.array_sort(F.collect_set("id")).alias("ids")))


class Windows:
    """The windows of a block of items, as positions in the items' words."""

    def __init__(self, items: list[tuple[str, list[str]]], size: int, shingle: int):
        self.items = [(line.encode().split(), ids) for line, ids in items]
        item, start, length, grams = [], [], [], []
        nth = np.arange(size)
        for i, (found, _) in enumerate(self.items):
            n = min(size, len(found))
            s = min(shingle, n)
            h = w.rolling(w.hashes(found), s)
            at = np.arange(len(found) - n + 1)
            item.append(np.full(len(at), i))
            start.append(at)
            length.append(np.full(len(at), n))
            # One row of shingles a window; short windows repeat their last one.
            grams.append(h[at[:, None] + np.minimum(nth, n - s)[None, :]])
        self.item, self.start, self.length = (
            np.concatenate(x) if x else np.empty(0, np.int64) for x in (item, start, length))
        self.grams = np.concatenate(grams) if grams else np.empty((0, size), np.uint64)
        self.width = np.minimum(self.length, shingle)
        self.widths = sorted(set(self.width.tolist()))


class Lookup:
    """Where a document's shingles equal one of the given hashes."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.table = np.zeros(1 << FILTER_BITS, bool)
        self.table[self.slot(self.keys)] = True

    @staticmethod
    def slot(h):
        return w.mix(h) >> np.uint64(64 - FILTER_BITS)

    def matches(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h``, and which key each of them equals."""
        at = np.flatnonzero(self.table[self.slot(h)])
        if not len(at):
            return at, at
        key = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        same = self.keys[key] == h[at]
        return at[same], key[same]


def shingle_counts(docs: DataFrame, windows: Windows) -> dict[int, dict[int, int]]:
    """How often the corpus has each shingle of the windows, by shingle width."""
    sc = docs.sparkSession.sparkContext
    lookups = sc.broadcast({
        s: Lookup(windows.grams[windows.width == s].ravel()) for s in windows.widths})

    def count(batches):
        total = {s: np.zeros(len(k.keys), np.int64) for s, k in lookups.value.items()}
        for batch in frames.slices(batches):
            for text in frames.texts(batch):
                h = w.hashes(w.plain_words(text))
                for s, lookup in lookups.value.items():
                    _, key = lookup.matches(w.rolling(h, s))
                    if len(key):
                        total[s] += np.bincount(key, minlength=len(total[s]))
        for s, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), s, np.int32)),
                 pa.array(lookups.value[s].keys[at].view(np.int64)), pa.array(n[at])],
                ["width", "gram", "n"])

    rows = (docs.select("text").mapInArrow(count, "width int, gram long, n long")
            .groupBy("width", "gram").agg(F.sum("n")).collect())
    out: dict[int, dict[int, int]] = {s: {} for s in windows.widths}
    for s, gram, n in rows:
        out[s][gram % (1 << 64)] = n
    return out


class Index:
    """Windows by their necessary prefix, for one shingle width."""

    def __init__(self, windows: Windows, width: int, counts: dict[int, int]):
        mine = np.flatnonzero(windows.width == width)
        grams = windows.grams[mine]
        known = Lookup(grams.ravel()).keys
        times = np.array([counts.get(int(k), 0) for k in known], np.int64)
        often = times[np.searchsorted(known, grams)] if len(known) else np.empty(grams.shape)
        rarest = np.argmin(often, axis=1)
        row = np.arange(len(mine))
        occurs = often[row, rarest] > 0
        mine, row, rarest = mine[occurs], row[occurs], rarest[occurs]
        prefix = grams[row, rarest]
        order = np.argsort(prefix, kind="stable")
        self.window, prefix = mine[order], prefix[order]
        self.offset = rarest[order]  # the first of equals, so never a repeated column
        self.lookup = Lookup(prefix)
        self.first = np.searchsorted(prefix, self.lookup.keys)
        self.count = np.diff(np.append(self.first, len(prefix)))

    def candidates(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window and start in the document, for every prefix match."""
        at, key = self.lookup.matches(h)
        times = self.count[key]
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        entry = np.repeat(self.first[key], times) + nth
        return self.window[entry], np.repeat(at, times) - self.offset[entry]


def search(found: list[bytes], windows: Windows, indexes: dict[int, Index]):
    """Merged hit spans and item ids of one document."""
    h = w.hashes(found)
    starts, lengths, items = [], [], set()
    for width, index in indexes.items():
        window, start = index.candidates(w.rolling(h, width))
        inside = (start >= 0) & (start + windows.length[window] <= len(found))
        for x, at in zip(window[inside].tolist(), start[inside].tolist()):
            i, j, n = windows.item[x], windows.start[x], windows.length[x]
            if found[at:at + n] == windows.items[i][0][j:j + n]:
                starts.append(at)
                lengths.append(n)
                items.add(i)
    if not starts:
        return [], []
    ids = sorted({x for i in items for x in windows.items[i][1]})
    return runs(w.covered(np.array(starts), np.array(lengths), len(found))), ids


def block_pass(docs: DataFrame, block: list, text: str, names: tuple[str, str, str],
               carry: tuple[str, ...], window: int, corpus: DataFrame) -> DataFrame:
    """One pass: n_words, spans and items (under ``names``) beside ``carry``."""
    windows = Windows(block, window, SHINGLE)
    counts = shingle_counts(corpus, windows)
    indexes = {s: Index(windows, s, counts[s]) for s in windows.widths}
    indexes = {s: x for s, x in indexes.items() if len(x.window)}
    windows.grams = None  # not needed any more
    shared = docs.sparkSession.sparkContext.broadcast((windows, indexes))

    def work(batch):
        out = []
        for body in frames.texts(batch, text):
            found = w.plain_words(body)
            out.append((len(found), *search(found, *shared.value)))
        return dict(zip(names, zip(*out)))

    schema = ", ".join(f"{n} {c.split(' ', 1)[1]}" for n, c in zip(names, FOUND.split(", ")))
    return frames.arrow_map(docs, work, schema, carry)


def blocks_of(items: DataFrame, block_bytes: int) -> int:
    size = items.agg(F.sum(F.octet_length("line")
                           + F.octet_length(F.concat_ws(",", "ids")))).first()[0] or 0
    return max(1, math.ceil(size / block_bytes))


def block(items: DataFrame, k: int, n: int) -> list:
    mine = items.filter(F.pmod(F.xxhash64("line"), F.lit(n)) == k)
    return sorted((r.line, r.ids) for r in mine.collect())


NAMES = ("n_words", "spans", "items")


def runs(hit: np.ndarray) -> list[dict]:
    """The runs of a boolean mask as start and end."""
    steps = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    edges = np.flatnonzero(steps).tolist()
    return [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2])]


def several_passes(docs: DataFrame, items: DataFrame, n: int, window: int) -> DataFrame:
    """doc_id, text_key, n_words, spans, items from one pass for each block.

    The first pass has every row, the later ones only rows with hits.
    """
    # The hash of the text tells rows of one doc_id apart.
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    row = F.struct("doc_id", "text_key")
    later = None
    for k in range(n):
        part = block_pass(keyed, block(items, k, n), "text", NAMES,
                          ("doc_id", "text_key"), window, docs)
        if k == 0:
            first = frames.staged(part).withColumn("row", row)
            continue
        part = frames.staged(part.filter(F.size("spans") > 0).withColumn("row", row))
        later = part if later is None else later.unionByName(part)
    more = later.groupBy("row").agg(
        F.flatten(F.collect_set("spans")).alias("more_spans"),
        F.flatten(F.collect_set("items")).alias("more_items"))
    empty = {"spans": F.array().cast("array<struct<start:long,end:long>>"),
             "items": F.array().cast("array<string>")}
    both = {c: F.concat(c, F.coalesce(f"more_{c}", e)) for c, e in empty.items()}
    rows = first.join(more, "row", "left").select(
        "doc_id", "text_key", "n_words", both["spans"].alias("all_spans"),
        F.array_sort(F.array_distinct(both["items"])).alias("items"))

    def work(batch):
        out = []
        for size, spans in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist()
                                 for c in ("n_words", "all_spans"))):
            a, b = (np.array([s[x] for s in spans], np.int64) for x in ("start", "end"))
            out.append(runs(w.covered(a, b - a, size)))
        return {"spans": out}

    return frames.arrow_map(rows, work, "spans array<struct<start:long,end:long>>",
                            ("doc_id", "text_key", "n_words", "items"))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For rows with doc_id and text: doc_id, n_words, spans (start, end of hit
    word runs) and items (their sorted ids)."""
    items = frames.staged(items_of(benchmark))
    n = blocks_of(items, block_bytes)
    if n == 1:
        return block_pass(docs, block(items, 0, 1), "text", NAMES, ("doc_id",), window, docs)
    return several_passes(docs, items, n, window).select("doc_id", *NAMES)


def hit_words(spans) -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def is_contaminated(n_words, spans) -> F.Column:
    return (hit_words(spans) > 0) & (20 * hit_words(spans) >= n_words)


def report(found: DataFrame) -> DataFrame:
    """Counts, digest of the item list, and the verdict."""
    spans, n_words = F.col("spans"), F.col("n_words")
    return found.select(
        "doc_id", "n_words", hit_words(spans).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        is_contaminated(n_words, spans).alias("contaminated"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated (hit words are a twentieth of the words or more)."""
    return report(hits(frames.keyed_texts(docs, id_col, text_col), benchmark,
                       block_bytes=block_bytes))


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns unchanged."""
    items = frames.staged(items_of(benchmark))
    n = blocks_of(items, block_bytes)
    key, corpus = frames.text_key(docs), frames.keyed_texts(docs, "doc_id", "text")
    if n == 1:
        keyed = docs.select(key.alias("key"), F.col("text").cast("string").alias("text"))
        found = block_pass(keyed, block(items, 0, 1), "text", NAMES, ("key",), window, corpus)
    else:
        found = several_passes(corpus, items, n, window).withColumn("key", F.struct(
            "doc_id", F.col("text_key").alias("text")))
    bad = found.filter(is_contaminated(F.col("n_words"), F.col("spans"))).select("key").distinct()
    return frames.without(docs, key, frames.staged(bad))
