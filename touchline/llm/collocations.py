"""Phrase collocations by marginalising the longest windows.

Every word starts one window of ``LENGTH`` words: lead columns w1, w2, w3, padded
with nulls at the end of its piece of text.  Only these longest windows are
counted.  Each occurrence of a shorter phrase is the beginning of just one
window, so Spark's ROLLUP over (lang, w1, w2, w3) sums them to the counts of all
shorter phrases and to the number of words of a language; there is no explosion
of its own for each phrase length.

What moves is kept small without changing a result.  Nothing but phrases of
``LEAST`` or more occurrences (and their parts, which are as frequent) enters a
score, so a first pass counts hashes of phrases, and marks the frequent ones in a
bitmap of ``BITS`` bits (16 MB, whatever the corpus).  In the second pass a window
is padded after its longest marked beginning: the counts of every frequent phrase
stay exact, since all its beginnings are marked.  A wrongly marked phrase (the bitmap
fills with a very large corpus) only lets more rows through.

Counted windows move packed: a task sums them, deals them by the hash of the whole
window and sends each range as one compressed row (a list of its words, and planes of
their numbers and counts).  All of a window meet in one range, are summed there, and
one of ``LENGTH`` words with fewer than ``LEAST`` occurrences loses its last word (it
is no phrase that counts, only its beginnings are).  ROLLUP reads these sums.

Counts of parts are joined to the candidates, on keys of which a few may be very
common: those with a thousandth of all rows (a thousand at most) are broadcast,
and their rows are spread over ``COPIES`` salted copies.  Ranks are taken in
``COPIES`` parts of a language first, so no task sorts a whole language.

Scores are exact: products are decimals of 38 digits, enough while a phrase has
up to 10 ** 15 occurrences.

Defined results: a null text is empty; a null language is ``und``; an empty table,
or one without frequent phrases, gives an empty result; each repeated row counts;
texts of any length are whole; ties are ordered by phrase, in bytes of UTF-8.
Other columns are not read, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm import frames
from touchline.llm import words as w

LENGTH = 3
LEAST = 10
#: A candidate goes if a longer one around it has this share of its occurrences.
SHARE = 50
TOP = 2_000
NO_LANG = "und"

NAMES = [f"w{k + 1}" for k in range(LENGTH)]
#: Lower-cases A-Z, makes tabs spaces and every end of a piece a full stop.
FLAT = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 46 if b in b".,;:!?\n\x0b\x0c\r" else b
             for b in range(256))

BITS = 1 << 27
#: Bits for the code of a word, and bytes of text that are counted at once in a task
#: (a word and a space are two bytes at least, so that the codes fit).
CODE = 21
PART = (4 << 20) - 64
#: Hashes that a task sums before it deals them, and bytes of text for each range
#: of hashes.
HELD = 3 << 20
RANGE_BYTES = 8 << 20
#: Ranges of hashes that share one range of windows, and the most ranges of windows
#: (so that what a task sends to one stays long enough to be packed).
SHARED = 4
MOST_RANGES = 1 << 10
#: Packed rows, and windows, that are handed to Spark at once.
PACKED = 256
UNPACKED = 1 << 17
COPIES = 64
#: Keys with at least one of so many rows are common (so there are no more of them).
COMMON = 1_000



def tokens(text: bytes) -> bytes:
    """Lower-cased words apart by spaces, with a stop wherever a piece ends."""
    return text.translate(FLAT).replace(b".", b" . ")


def lead_columns(codes: np.ndarray, stop: int, last: bool) -> list[np.ndarray]:
    """The window that starts at each word: LENGTH columns, -1 where padded.

    Of a part that goes on, the windows of its last words are left to the next one.
    """
    size = len(codes) if last else max(len(codes) - LENGTH + 1, 0)
    padded = np.concatenate((codes, np.full(LENGTH, stop, codes.dtype)))
    open_, columns = np.ones(size, bool), []
    for k in range(LENGTH):
        word = padded[k:k + size]
        open_ = open_ & (word != stop)
        columns.append(np.where(open_, word, -1))
    keep = columns[0] >= 0
    return [c[keep] for c in columns]


def parts(lines: list[bytes]) -> Iterator[tuple[list[bytes], np.ndarray, int, bool]]:
    """Distinct words, their places in a part of the text, the code of a stop, and
    whether the text ends there.  Parts have about ``PART`` bytes."""
    line = b" . ".join(lines)
    ahead, at = b"", 0
    while True:
        end = line.find(b" ", at + PART)
        last = end < 0
        part = ahead + line[at:len(line) if last else end] + b" ."
        split = pc.split_pattern(pa.array([part], pa.large_binary()), " ").flatten()
        found = split.cast(pa.binary()).dictionary_encode()
        words = found.dictionary.to_pylist()
        codes = found.indices.to_numpy(zero_copy_only=False)
        # The stop that was added gave the stop a code; it is not in the text.
        stop = words.index(b".")
        codes = codes[:-1]
        if b"" in words:
            codes = codes[codes != words.index(b"")]
        yield words, codes, stop, last
        if last:
            return
        ahead = b" ".join([*(words[c] for c in codes[-(LENGTH - 1):]), b""])
        at = end


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[
        tuple[bytes, list[bytes], list[np.ndarray]]]:
    """Language, words, and the lead columns (codes of words), part by part."""
    for lang, lines in gathered(batches):
        for words, codes, stop, last in parts(lines):
            columns = lead_columns(codes, stop, last)
            if len(columns[0]):
                yield lang, words, columns


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list[bytes]]]:
    """Texts of one language, about ``PART`` bytes of all languages at a time."""
    held: dict[bytes, list[bytes]] = {}
    size = 0
    for batch in frames.slices(batches):
        for lang, text in zip(frames.texts(batch, "lang"), frames.texts(batch, "text")):
            held.setdefault(lang, []).append(tokens(text))
            size += len(text)
            if size >= PART:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each is there."""
    keys = np.sort(keys)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[:len(keys)])
    return keys[starts], np.diff(np.append(starts, len(keys)))


def sums(keys: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their sums of ``f``."""
    order = np.argsort(keys)
    keys, f = keys[order], f[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[:len(keys)])
    return keys[starts], np.add.reduceat(f, starts) if len(starts) else f


def window_keys(columns: list[np.ndarray]) -> np.ndarray:
    """The codes of a window side by side (0 where padded)."""
    key = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        key = key << np.uint64(CODE) | (column + 1).astype(np.uint64)
    return key


def codes_of(keys: np.ndarray, size: int) -> list[np.ndarray]:
    mask = np.uint64((1 << CODE) - 1)
    return [(keys >> np.uint64(CODE * k) & mask).astype(np.int64) - 1
            for k in reversed(range(size))]


def hashes_of(lang: bytes, words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the words of a language (and one for padding)."""
    return w.mix(np.append(w.hashes(words), np.uint64(0)) ^ w.hashes([lang])[0])


def joined_hashes(first: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Hash of a phrase from those of its beginning and of its last word."""
    return w.mix(first * np.uint64(w.BASE) + following)


def ranges_for(texts: DataFrame) -> int:
    """Into so many ranges of hashes the pairs are dealt: what a range gets fits
    easily into a task."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return 1 << max(4, (size // RANGE_BYTES).bit_length())


def bit_numbers(hashed: np.ndarray) -> np.ndarray:
    """The bitmap's bits of hashes: their leading bits, which all travel."""
    return hashed >> np.uint64(65 - BITS.bit_length())


def frequent_bits(texts: DataFrame, least: int, ranges: int) -> np.ndarray:
    """The bitmap of the hashes of phrases with ``least`` occurrences.

    Hashes travel sorted and packed, a row for each range that a task has any in:
    the 32 bits after the range's own, in planes of bytes (the first ones hardly
    change, so they compress), and counts, held at ``least``.  Equal hashes of
    different phrases only let more windows through.
    """
    range_bits = ranges.bit_length() - 1
    shift, low = np.uint64(64 - range_bits), np.uint64(32 - range_bits)
    kind = np.uint8 if least < 256 else np.uint32

    def dealt(found):
        value, f = sums(*(np.concatenate(x) for x in zip(*found)))
        of, rest = value >> shift, (value >> low).astype(">u4")
        f = np.minimum(f, least).astype(kind)
        edges = np.append(np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))), len(of))
        for at in range(0, len(edges) - 1, 256):
            part = list(zip(edges[at:at + 256], edges[at + 1:at + 257]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(of[x]) for x, _ in part]),
                 pa.array([rest[x:y].view(np.uint8).reshape(-1, 4).T.tobytes() for x, y in part]),
                 pa.array([f[x:y].tobytes() for x, y in part])], ["range", "hashes", "f"])

    def count(batches):
        found, size = [], 0
        for lang, words, columns in windows(batches):
            h = hashes_of(lang, words)
            times = np.bincount(columns[0], minlength=len(words))
            used = np.flatnonzero(times)
            found.append((h[used], times[used]))
            for n in range(2, LENGTH + 1):
                whole = columns[n - 1] >= 0
                keys, times = runs(window_keys([c[whole] for c in columns[:n]]))
                first, *others = (h[c] for c in codes_of(keys, n))
                for following in others:
                    first = joined_hashes(first, following)
                found.append((first, times))
            size += sum(len(x) for x, _ in found[-LENGTH:])
            if size >= HELD:
                yield from dealt(found)
                found, size = [], 0
        if found:
            yield from dealt(found)

    def often(batches):
        """The words of the bitmap that the frequent hashes of a task's ranges fill."""
        bits = np.zeros(BITS // 64, np.uint64)

        def fill(of, found):
            rest, f = sums(*(np.concatenate(x) for x in zip(*found)))
            value = np.uint64(of) << shift | rest[f >= least].astype(np.uint64) << low
            frames.set_bits(bits, bit_numbers(value))

        now, found = None, []
        for batch in batches:
            for one, hashes, f in zip(*(c.to_pylist() for c in batch.columns)):
                if one != now and found:
                    fill(now, found)
                    found = []
                now = one
                rest = np.frombuffer(hashes, np.uint8).reshape(4, -1).T.copy().view(">u4")
                found.append((rest.ravel().astype(np.uint32), np.frombuffer(f, kind).astype(np.int64)))
        if found:
            fill(now, found)
        yield frames.words_of(bits)

    rows = (texts.mapInArrow(count, "range long, hashes binary, f binary")
            .repartition("range").sortWithinPartitions("range").mapInArrow(often, "word long, mask long"))
    return frames.bitmap(rows, BITS)


def pooled(found: Iterator[tuple[bytes, list[bytes], list[np.ndarray], np.ndarray]]
           ) -> Iterator[tuple[bytes, list[bytes], np.ndarray, np.ndarray, bool]]:
    """Windows of many parts, summed by language: language, words, keys, counts, and
    whether this is all there is.  About ``HELD`` of them are held at a time."""
    codes: dict[bytes, dict[bytes, int]] = {}
    held: dict[bytes, list[tuple[np.ndarray, np.ndarray]]] = {}
    size, whole = 0, True

    def out():
        for lang, some in held.items():
            yield lang, list(codes[lang]), *sums(*(np.concatenate(x) for x in zip(*some))), whole

    for lang, words, columns, times in found:
        if size >= HELD or len(codes.get(lang, ())) + len(words) >= (1 << CODE) - 1:
            whole = False
            yield from out()
            codes, held, size = {}, {}, 0
        known = codes.setdefault(lang, {})
        code = np.array([*(known.setdefault(x, len(known)) for x in words), -1])
        held.setdefault(lang, []).append((window_keys([code[c] for c in columns]), times))
        size += len(times)
    yield from out()


def planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones, and so on."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def values_of(data: bytes, kind: str, size: int, at: int) -> np.ndarray:
    kind = np.dtype(kind)
    found = np.frombuffer(data, np.uint8, size * kind.itemsize, at)
    return found.reshape(kind.itemsize, -1).T.copy().view(kind).ravel()


def numbered(words: list[bytes], columns: list[np.ndarray]) -> tuple[list[bytes], np.ndarray]:
    """The words that columns have (padding as an empty one, first), and their places there."""
    used, at = np.unique(np.concatenate(columns), return_inverse=True)
    return [words[c] if c >= 0 else b"" for c in used], at.reshape(LENGTH, -1)


def pack(words: list[bytes], columns: list[np.ndarray], times: np.ndarray) -> tuple[int, int, bytes]:
    """Windows and their counts as number of windows, bytes, compressed bytes."""
    used, at = numbered(words, columns)
    data = planes(at.ravel().astype("<u4")) + planes(times.astype("<i8")) + b" ".join(used)
    return len(times), len(data), pa.compress(data, "zstd", asbytes=True)


def unpack(size: int, length: int, data: bytes) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
    """Words, lead columns and counts of packed windows."""
    data = pa.decompress(data, length, "zstd", asbytes=True)
    at = values_of(data, "<u4", LENGTH * size, 0).astype(np.int64).reshape(LENGTH, -1)
    times = values_of(data, "<i8", size, 4 * LENGTH * size)
    words = data[(4 * LENGTH + 8) * size:].split(b" ")
    padded = not words[0]
    return words[padded:], list(at - padded), times


def packed_windows(texts: DataFrame, bits: np.ndarray, ranges: int) -> DataFrame:
    """range, lang, size, length, data: the windows of a task, counted, without the
    words that no frequent phrase of theirs can have; a row for each range of hashes."""
    model = texts.sparkSession.sparkContext.broadcast(bits)
    shift = np.uint64(65 - ranges.bit_length())

    def marked(hashed: np.ndarray) -> np.ndarray:
        return frames.has_bits(model.value, bit_numbers(hashed))

    def shown(batches):
        for lang, words, columns in windows(batches):
            h = hashes_of(lang, words)
            hashed, kept = h[columns[0]], marked(h)[columns[0]]
            left = [np.where(kept, columns[0], -1)]
            for column in columns[1:]:
                kept = kept & (column >= 0)
                hashed = joined_hashes(hashed, h[column])
                kept[kept] = marked(hashed[kept])
                left.append(np.where(kept, column, -1))
            keys, times = runs(window_keys(left))
            used, at = numbered(words, codes_of(keys, LENGTH))
            padded = not used[0]
            yield lang, used[padded:], list(at - padded), times

    def work(batches):
        for lang, words, keys, times, _ in pooled(shown(batches)):
            h = hashes_of(lang, words)
            hashed, *others = (h[c] for c in codes_of(keys, LENGTH))
            for following in others:
                hashed = joined_hashes(hashed, following)
            of = hashed >> shift
            del hashed, others
            order = np.argsort(of, kind="stable")
            of, keys, times = of[order], keys[order], times[order]
            edges = np.append(np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))), len(of))
            for at in range(0, len(edges) - 1, PACKED):
                some = list(zip(edges[at:at + PACKED], edges[at + 1:at + PACKED + 1]))
                size, length, data = zip(*(
                    pack(words, codes_of(keys[x:y], LENGTH), times[x:y]) for x, y in some))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(of[x]) for x, _ in some]),
                     pa.array([lang] * len(some), pa.binary()).cast(pa.string()),
                     pa.array(size), pa.array(length), pa.array(data, pa.binary())],
                    ["range", "lang", "size", "length", "data"])

    return texts.mapInArrow(work, "range long, lang string, size long, length long, data binary")


def longest_windows(texts: DataFrame, bits: np.ndarray, ranges: int = 16,
                    least: int = LEAST) -> DataFrame:
    """lang, w1, w2, w3, f: the counted windows, each summed in the range it is dealt to.

    A window of ``LENGTH`` words with fewer than ``least`` occurrences loses the last one.
    """
    last = np.uint64((1 << CODE) - 1)

    def work(batches):
        rows = (row for batch in batches for row in zip(
            *(frames.texts(batch, c) if c == "lang" else batch.column(c).to_pylist()
              for c in batch.schema.names)))
        for _, some in groupby(rows, itemgetter(0)):
            for lang, words, keys, times, whole in pooled(
                    (lang, *unpack(*packed)) for _, lang, *packed in some):
                if whole:
                    keys, times = sums(np.where((times < least) & (keys & last > 0),
                                                keys & ~last, keys), times)
                text = pa.array(words, pa.string())
                name = pa.array([lang], pa.binary()).cast(pa.string())
                for at in range(0, len(keys), UNPACKED):
                    some_keys = keys[at:at + UNPACKED]
                    yield pa.RecordBatch.from_arrays(
                        [name.take(np.zeros(len(some_keys), int)),
                         *(text.take(pa.array(c, mask=c < 0)) for c in codes_of(some_keys, LENGTH)),
                         pa.array(times[at:at + UNPACKED])], ["lang", *NAMES, "f"])

    return (packed_windows(texts, bits, ranges).repartition("range").sortWithinPartitions("range")
            .mapInArrow(work, "lang string, w1 string, w2 string, w3 string, f long"))


def phrase_counts(docs: DataFrame, lang: str = "lang", text: str = "text",
                  least: int = LEAST) -> DataFrame:
    """lang, size, phrase, f: all phrases of ``least`` or more occurrences; size 0
    has the number of words of the language."""
    texts = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(NO_LANG)).alias("lang"),
                        F.col(f"`{text}`").cast("string").alias("text"))
    ranges = ranges_for(texts)
    longest = longest_windows(texts, frequent_bits(texts, least, ranges),
                              min(max(ranges // SHARED, 16), MOST_RANGES), least)
    rolled = longest.rollup("lang", *NAMES).agg(
        F.sum("f").alias("f"), F.grouping_id("lang", *NAMES).alias("level"))
    # A prefix that ends in padding is not a phrase: its level is dropped.
    size = LENGTH - F.bit_count("level")
    whole = F.array_size(F.array_compact(F.array(*NAMES))) == F.col("size")
    return (rolled.filter(F.col("level") < (1 << LENGTH)).withColumn("size", size)
            .filter(whole & ((F.col("size") == 0) | (F.col("f") >= least)))
            .select("lang", "size", F.concat_ws(" ", *NAMES).alias("phrase"), "f"))


def part_counts(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds ``f``, the count of the phrase in column ``part``.

    A part that very many rows have is spread over salted copies.
    """
    many = max(rows.count() // COMMON, COPIES)
    common = frames.staged(
        rows.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("rows"))
        .filter(F.col("rows") > many).select("lang", "part", F.lit(COPIES).alias("copies")))
    salt = F.pmod(F.xxhash64("phrase", "cut"), F.coalesce("copies", F.lit(1))).cast("int")
    left = rows.join(F.broadcast(common), ["lang", "part"], "left").withColumn("salt", salt)
    right = (counts.withColumnRenamed("phrase", "part")
             .join(F.broadcast(common), ["lang", "part"], "left")
             .select("lang", "part", "f", F.explode(F.sequence(
                 F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("salt")))
    return left.drop("copies").join(right, ["lang", "part", "salt"]).drop("salt")


def scored(counts: DataFrame) -> DataFrame:
    """lang, size, phrase, a, l, r, score: every candidate with its lowest cut."""
    words = F.split("phrase", " ")
    halves = F.array(F.array_join(F.slice(words, F.lit(1), F.col("cut")), " "),
                     F.array_join(F.slice(words, F.col("cut") + 1, F.col("size")), " "))
    rows = (counts.filter("size >= 2").withColumnRenamed("f", "a")
            .withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
            .select("*", F.posexplode(halves).alias("side", "part")))
    smaller = counts.filter((F.col("size") > 0) & (F.col("size") < LENGTH)).drop("size")
    found = part_counts(rows, smaller)
    phrase = ["lang", "size", "phrase", "a"]
    half = [F.max(F.when((F.col("cut") == k) & (F.col("side") == side), F.col("f"))).alias(
        f"{name}{k}") for k in range(1, LENGTH) for side, name in enumerate("lr")]
    exact = "cast({} AS decimal(15,0))".format
    cuts = F.array_compact(F.array(*[F.when(F.col(f"l{k}").isNotNull(), F.struct(
        F.expr(f"(1000000BD * {exact('a')} * {exact('a')}) div ({exact(f'l{k}')} * {exact(f'r{k}')})")
        .cast("long").alias("score"), F.lit(k).alias("cut"), F.col(f"l{k}").alias("l"),
        F.col(f"r{k}").alias("r"))) for k in range(1, LENGTH)]))
    return (found.groupBy(*phrase).agg(*half).withColumn("best", F.array_min(cuts))
            .select(*phrase, "best.l", "best.r", "best.score"))


def covered(candidates: DataFrame, share: int = SHARE) -> DataFrame:
    """lang, phrase of the candidates inside a longer one that is frequent enough."""
    words = F.split("phrase", " ")
    pieces = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("size") - n + 1), lambda at: F.array_join(
            F.slice(words, at, n), " "))))
    inner = (candidates.filter("size > 2")
             .select("lang", F.explode(pieces).alias("phrase"), F.col("a").alias("longer"))
             .groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
    return (candidates.filter(F.col("size") < LENGTH).select("lang", "phrase", "a")
            .join(inner, ["lang", "phrase"]).filter(100 * F.col("longer") >= share * F.col("a"))
            .select("lang", "phrase"))


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language, with their rank."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(COPIES))
    part = Window.partitionBy("lang", "_salt").orderBy(*order)
    some = (rows.withColumn("_salt", salt).withColumn("_place", F.row_number().over(part))
            .filter(F.col("_place") <= top))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return some.withColumn("rank", place.cast("long")).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text",
                 least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language."""
    counts = frames.staged(phrase_counts(docs, lang_col, text_col, least))
    candidates = scored(counts)
    kept = candidates.join(covered(counts.filter("size >= 2").withColumnRenamed("f", "a"), share),
                           ["lang", "phrase"], "left_anti")
    totals = counts.filter("size = 0").select("lang", F.col("f").alias("n"))
    return ranked(kept, top).join(F.broadcast(totals), "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
