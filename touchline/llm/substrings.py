"""Substring deduplication by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words.  Its minimiser is the leftmost of its
``MER``-word runs with the least hash, so equal windows have equal minimisers.
Consecutive windows that share one travel together, as one packed string of
their words, to the minimiser's bucket: about three words are shipped for each
word of the text, instead of fifty.  A task packs and compresses what it sends
to the same bucket.  In a bucket the windows are sorted by hash, and stretches
of them that meet others are compared by their bytes with the least document
that has them.

Minimisers of more than ``CROWDED`` super-k-mers (the ``HOT_SET`` largest of
them) would make one bucket grow with the input.  Their windows travel singly, to
the bucket of the window's own hash, and equal ones are combined before that: a
task sends one of the least document it has seen, and reports the others itself.

The number of buckets follows the size of the texts (``BUCKET_BYTES`` of packed
text each), so a task holds the same amount at any scale.

Defined results: a null text has no words; a text of fewer words than a window
loses nothing; a null doc_id counts as larger than all others (never a reason
for removal elsewhere); rows with the same doc_id never remove from each other;
an empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import frames, words as w
from touchline.llm.simhash import signed

WINDOW = 50
MER = 4
#: Packed text of one bucket, and packed text a task holds before it sends it.
BUCKET_BYTES = 8 << 20
BUFFER_BYTES = 24 << 20
CROWDED = 10_000
HOT_SET = 100_000
LAST = (1 << 63) - 1


def minimisers(h: np.ndarray, window: int, mer: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of the minimiser of every window."""
    n = len(h) - window + 1
    value = w.mix(w.rolling(h, mer))
    best, width, reach = np.arange(len(value)), 1, window - mer + 1

    def least(a, b):
        return np.where(value[a] <= value[b], a, b)

    while 2 * width <= reach:
        best, width = least(best[:-width], best[width:]), 2 * width
    at = least(best[:n], best[reach - width:reach - width + n])
    return value[at], at


class Runs:
    """The super-k-mers of some texts, all worked out at once.

    ``found`` has the words of all texts, ``doc`` and ``first`` the text and the
    place of each run's first window, ``count`` its windows, ``start`` the place
    counted from the text's own first word.
    """

    def __init__(self, texts: list[bytes], window: int, mer: int):
        split = [w.spaced_words(t) for t in texts]
        self.found = list(chain.from_iterable(split))
        self.h = w.hashes(self.found)
        size = np.fromiter(map(len, split), np.int64, len(split))
        begin = np.cumsum(size) - size
        n = max(len(self.h) - window + 1, 0)
        self.value, self.first = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.doc = self.start = self.count = self.first
        if not n:
            return
        value, at = minimisers(self.h, window, mer)
        doc = np.repeat(np.arange(len(split)), size)[:n]
        whole = np.flatnonzero(np.arange(n) + window <= (begin + size)[doc])
        if not len(whole):
            return
        new = (np.diff(whole) != 1) | (np.diff(at[whole]) != 0) | (np.diff(doc[whole]) != 0)
        edge = np.concatenate(([0], np.flatnonzero(new) + 1))
        self.first = whole[edge]
        self.count = np.diff(np.append(edge, len(whole)))
        self.value, self.doc = value[self.first], doc[self.first]
        self.start = self.first - begin[self.doc]


def offsets(found: list[bytes]) -> np.ndarray:
    """Where each word starts in the words joined by one byte, and one more."""
    return np.concatenate(([0], np.cumsum(
        np.fromiter(map(len, found), np.int64, len(found)) + 1)))


def keys_of(batch, bodies: list[bytes]) -> tuple[list[int], list[int]]:
    """doc_id with nulls last, text_key."""
    ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
    return ([LAST if i is None else i for i in ids],
            [signed(xxhash.xxh3_64_intdigest(b)) for b in bodies])


def hot_minimisers(docs: DataFrame, window: int, mer: int, crowded: int) -> list[int]:
    """Minimisers of more than ``crowded`` super-k-mers (signed), at most the
    ``HOT_SET`` largest.  This decides how windows travel, never what is found."""
    def count(batches):
        for batch in batches:
            found = [Runs(frames.texts(part), window, mer).value
                     for part in frames.slices([batch])]
            value, times = np.unique(np.concatenate([np.empty(0, np.uint64), *found]),
                                     return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(value.view(np.int64)), pa.array(times)], ["value", "n"])

    counts = (docs.select("text").mapInArrow(count, "value long, n long")
              .groupBy("value").agg(F.sum("n").alias("n")).filter(F.col("n") > crowded))
    return [r[0] for r in counts.orderBy(F.desc("n"), "value").limit(HOT_SET).collect()]


class Outbox:
    """What a task sends: packed strings by bucket, and spans it has settled."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.empty()

    def empty(self):
        self.held, self.size = {}, 0
        self.single: dict[bytes, tuple[int, list]] = {}
        self.settled: list[tuple[int, int, int]] = []

    def add(self, bucket: int, meta: tuple, body: bytes):
        metas, bodies = self.held.setdefault(bucket, ([], []))
        metas.append(meta)
        bodies.append(body)
        self.size += len(body)

    def add_single(self, body: bytes, doc: int, key: int, start: int):
        """A window of a crowded minimiser: keep those of the least document."""
        have = self.single.get(body)
        if have is None or doc < have[0]:
            if have is None:
                self.size += len(body)
            else:
                self.settled.extend((have[0], *x) for x in have[1])
            self.single[body] = (doc, [(key, start)])
        elif doc == have[0]:
            have[1].append((key, start))
        else:
            self.settled.append((doc, key, start))

    def sent(self, window: int):
        for body, (doc, places) in self.single.items():
            bucket = xxhash.xxh3_64_intdigest(body) % self.buckets
            for key, start in places:
                self.add(bucket, (doc, key, start, 1), body)
        press = zstandard.ZstdCompressor(level=3)
        order = sorted(self.held)
        for some in range(0, len(order), 64):
            part = order[some:some + 64]
            yield rows_to_send(
                part, [np.array(self.held[b][0], np.int64) for b in part],
                [press.compress(b"\n".join(self.held[b][1])) for b in part])
        if self.settled:
            doc, key, start = np.array(sorted(self.settled), np.int64).T
            spans = stretches(doc, key, start, np.ones(len(doc), bool), window)
            meta = np.stack([c.to_numpy() for c in spans.columns], axis=1)
            to = (w.mix(meta[:, 0].astype(np.uint64)) % np.uint64(self.buckets)).astype(np.int64)
            part = np.unique(to).tolist()
            yield rows_to_send(part, [meta[to == b] for b in part], [b""] * len(part))
        self.empty()


def rows_to_send(buckets, metas, bodies) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets, pa.int32()), pa.array([m.tobytes() for m in metas], pa.binary()),
         pa.array(bodies, pa.binary())], ["bucket", "meta", "body"])


def packed(docs: DataFrame, buckets: int, hot: list[int], window: int, mer: int) -> DataFrame:
    """bucket, meta, body: packed strings (one a line, compressed) with doc_id,
    text_key, first window and number of windows; or, where body is empty,
    settled spans as doc_id, text_key, start, end."""
    crowded = docs.sparkSession.sparkContext.broadcast(
        np.array(sorted(hot), np.int64).view(np.uint64))

    def pack(batches):
        out = Outbox(buckets)
        for batch in frames.slices(batches):
            bodies = frames.texts(batch)
            ids, keys = keys_of(batch, bodies)
            runs = Runs(bodies, window, mer)
            if not len(runs.value):
                continue
            line, at = b" ".join(runs.found), offsets(runs.found)
            bucket = (w.mix(runs.value + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
            single = (np.isin(runs.value, crowded.value) if len(crowded.value)
                      else np.zeros(len(bucket), bool))
            a, b = at[runs.first], at[runs.first + runs.count + window - 1] - 1
            for x, y, k, d, s, c, one, f in zip(*(v.tolist() for v in (
                    a, b, bucket, runs.doc, runs.start, runs.count, single, runs.first))):
                if one:
                    for i in range(c):
                        out.add_single(line[at[f + i]:at[f + i + window] - 1], ids[d], keys[d], s + i)
                else:
                    out.add(k, (ids[d], keys[d], s, c), line[x:y])
            if out.size >= BUFFER_BYTES or len(out.settled) >= 1 << 18:
                yield from out.sent(window)
        yield from out.sent(window)

    return docs.mapInArrow(pack, "bucket int, meta binary, body binary")


REMOVED = "doc_id long, text_key long, start long, end long"


def stretches(doc, key, start, flagged, window: int) -> pa.RecordBatch:
    """Runs of flagged windows as word spans; equal doc, key and steps of one in
    ``start`` make a run."""
    doc, key, start = doc[flagged], key[flagged], start[flagged]
    if len(doc):
        first = np.flatnonzero(np.concatenate((
            [True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1))))
        last = np.append(first[1:], len(doc)) - 1
        doc, key, start, end = doc[first], key[first], start[first], start[last] + window
    else:
        end = start
    return pa.RecordBatch.from_arrays(
        [pa.array(x) for x in (doc, key, start, end)], ["doc_id", "text_key", "start", "end"])


def repeated(meta: np.ndarray, bodies: list[bytes], window: int) -> pa.RecordBatch:
    """Spans of one bucket's windows that a smaller document has too."""
    body = b"\n".join(bodies)
    found = body.split()
    at, h = offsets(found), w.rolling(w.hashes(found), window)
    del found  # as large as all the rest
    count, words = meta[:, 3], meta[:, 3] + window - 1
    run = np.repeat(np.arange(len(meta)), count)
    nth = np.arange(len(run)) - (np.cumsum(count) - count)[run]
    place = (np.cumsum(words) - words)[run] + nth
    value, flagged = h[place], np.zeros(len(run), bool)
    order = np.argsort(value)
    same = value[order][1:] == value[order][:-1]
    # Windows whose hash comes up again, by hash, then document, then place.
    some = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
    some = some[np.lexsort((some, meta[run[some], 0], value[some]))]
    if len(some):
        first = np.concatenate(([True], value[some][1:] != value[some][:-1]))
        least = some[np.flatnonzero(first)][np.cumsum(first) - 1]
        more = meta[run[some], 0] > meta[run[least], 0]
        window_at, least_at = some[more], least[more]
        back = np.argsort(window_at)
        window_at, least_at = window_at[back], least_at[back]
        flagged[window_at] = True
        if not equal_bytes(body, at, place[window_at], place[least_at], window):
            flagged = by_content(body, at, place, meta[run, 0], window)
    return stretches(meta[run, 0], meta[run, 1], meta[run, 2] + nth, flagged, window)


def equal_bytes(body: bytes, at: np.ndarray, a: np.ndarray, b: np.ndarray, window: int) -> bool:
    """Whether windows at ``a`` have the words of those at ``b``; windows that go
    on by one word in both are compared together."""
    if not len(a):
        return True
    first = np.flatnonzero(np.concatenate(([True], (np.diff(a) != 1) | (np.diff(b) != 1))))
    last = np.append(first[1:], len(a)) - 1
    ends = [at[x[last] + window] - 1 for x in (a, b)]
    return all(body[p:q] == body[r:s] for p, q, r, s in zip(
        at[a[first]].tolist(), ends[0].tolist(), at[b[first]].tolist(), ends[1].tolist()))


def by_content(body: bytes, at: np.ndarray, place, doc, window: int) -> np.ndarray:
    """The same for a bucket where different windows have one hash."""
    texts = [body[x:y] for x, y in zip(at[place].tolist(), (at[place + window] - 1).tolist())]
    least: dict[bytes, int] = {}
    for t, d in zip(texts, doc.tolist()):
        least[t] = min(d, least.get(t, d))
    return np.array([d > least[t] for t, d in zip(texts, doc.tolist())], bool)


def bucket_spans(rows: DataFrame, window: int) -> DataFrame:
    def work(batches):
        open_, current, metas, bodies = zstandard.ZstdDecompressor(), None, [], []

        def done():
            if metas:
                yield repeated(np.concatenate(metas), bodies, window)

        for batch in batches:
            for at in range(batch.num_rows):
                bucket, meta, body = (batch.column(i)[at].as_py() for i in range(3))
                meta = np.frombuffer(meta, np.int64).reshape(-1, 4)
                if not body:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c) for c in meta.T], [c.split()[0] for c in REMOVED.split(", ")])
                    continue
                if bucket != current:
                    yield from done()
                    current, metas, bodies = bucket, [], []
                metas.append(meta)
                bodies.extend(open_.decompress(body).split(b"\n"))
        yield from done()

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(work, REMOVED)


def removed_spans(docs: DataFrame, window: int = WINDOW, mer: int = MER,
                  crowded: int = CROWDED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, text_key, start, end: word spans to remove (may overlap)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-3 * size // bucket_bytes))
    hot = hot_minimisers(docs, window, mer, crowded)
    return bucket_spans(packed(docs, buckets, hot, window, mer), window)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 window: int = WINDOW, mer: int = MER, crowded: int = CROWDED,
                 bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (words that stay,
    joined by one space)."""
    texts = frames.keyed_texts(docs, id_col, text_col)
    spans = removed_spans(texts, window, mer, crowded, bucket_bytes)
    grouped = frames.staged(
        spans.groupBy(F.struct(F.col("doc_id").alias("i"), F.col("text_key").alias("k")).alias("row"))
        .agg(F.collect_set(F.struct("start", "end")).alias("spans")))

    keyed = frames.arrow_map(
        texts, lambda b: dict(zip(("i", "k"), keys_of(b, frames.texts(b)))),
        "i long, k long", ("doc_id", "text"))
    joined = (keyed.withColumn("row", F.struct("i", "k")).join(grouped, "row", "left")
              .select("doc_id", "text", "spans"))

    def cut(batch):
        out = []
        for text, spans in zip(frames.texts(batch), batch.column(
                batch.schema.get_field_index("spans")).to_pylist()):
            found = w.spaced_words(text)
            if not spans:
                out.append((len(found), 0, b" ".join(found).decode("utf-8", "replace")))
                continue
            a, b = (np.array([s[x] for s in spans]) for x in ("start", "end"))
            gone = w.covered(a, b - a, len(found))
            kept = b" ".join(x for x, g in zip(found, gone.tolist()) if not g)
            out.append((len(found), int(gone.sum()), kept.decode("utf-8", "replace")))
        return dict(zip(("n_words", "n_removed", "kept"), zip(*out)))

    return frames.arrow_map(joined, cut, "n_words long, n_removed long, kept string", ("doc_id",))


def report(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
