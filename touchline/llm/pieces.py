"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text is segmented into the pieces with the greatest sum of scores (unknown
characters are spelled in bytes), as the library's unigram encoder does it; of
equal sums the one whose last piece starts first wins, at every position.

Best scores are max-plus linear in the scores at the start, so a giant document
is cut anywhere into chunks of ``CHUNK`` characters:

1. each chunk gives its transfer matrix: the best score from every state at its
   left edge (how many of its characters a piece begun before already covers) to
   every state at its right edge;
2. matrices are combined associatively, first in blocks of ``FAN`` chunks, then
   over the blocks, and give every chunk the scores at its left edge;
3. with these, each chunk maps right states to left states along its best paths;
   the maps are composed the same way, from the right, and name every chunk's
   right state;
4. each chunk is then backtraced on its own, and its pieces are put in place.

Chunks travel as rows, so the work on one document is spread over tasks; what is
gathered for a document before its result are vectors of a few numbers a chunk.
No piece has a space after another character, so segmentations of words are
independent; tasks remember those of recent words (``MEMO`` at most).

The pieces come from a model file, never trained here; the driver reads them
and broadcasts the vocabulary (its size does not depend on the data).  The given
file is of the merge kind, whose own encoder follows merge order; here its
scores are maximised, as in a unigram model with these pieces.  Decoding joins
the pieces; it gives back every text exactly (the character U+2581 is spelled in
bytes for that).

Defined results: null and empty texts have no pieces and decode to the empty
text; repeated rows are each encoded; an empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import frames
from touchline.llm.simhash import signed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 16
FAN = 64
MEMO = 120_000
#: Characters of units that are segmented at once.
BATCH_CHARS = 1 << 16
PREFIX_BASE = np.uint64(0x9E3779B97F4A7C15)
SPACE = "▁"
NEVER = float("-inf")
#: What an unknown character costs beyond the worst piece (the library's value).
UNKNOWN = 10.0


def vocabulary(path: str = MODEL) -> dict:
    """Pieces with a blank for U+2581, their ids and scores, and the byte ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, spelled, known = {}, [0] * 256, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            spelled[int(piece[3:5], 16)] = i
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        pieces[piece.replace(SPACE, " ")] = (i, model.get_score(i))
        known.append(model.get_score(i))
    return {"pieces": pieces, "bytes": spelled, "unknown": min(known) - UNKNOWN,
            "size": model.get_piece_size()}


class Segmenter:
    """Best segmentations with one vocabulary."""

    def __init__(self, vocabulary: dict):
        self.score = {p: s for p, (_, s) in vocabulary["pieces"].items()}
        self.id = {p: i for p, (i, _) in vocabulary["pieces"].items()}
        self.spelled, self.unknown = vocabulary["bytes"], vocabulary["unknown"]
        self.longest: dict[str, int] = {}
        for p in self.score:
            self.longest[p[0]] = max(len(p), self.longest.get(p[0], 1))
        #: States at an edge: characters of the next chunk already covered.
        self.states = max(map(len, self.score), default=1)
        inside = any(re.search("[^ ] ", p) for p in self.score)
        breaks = "" if any("\n" in p for p in self.score) else "\n"
        self.units = re.compile("(?s).+" if inside else
                                rf" +[^ {breaks}]*|[^ {breaks}]+" + (r"|\n" if breaks else ""))
        self.memo: dict[str, tuple[float, bytes]] = {}
        self.prefixes = self.prefix_tables()

    def best(self, s: str, n: int, entry: list[float]):
        """Best score and last piece's start for every place in ``s``, by pieces
        that start before ``n``; ``entry`` holds the scores of places reached
        from outside (start -1)."""
        size, score, longest = len(s), self.score, self.longest
        best, back = [NEVER] * (size + 1), [-1] * (size + 1)
        best[:len(entry)] = entry[:size + 1]
        for i in range(n):
            here = best[i]
            if here == NEVER:
                continue
            reach = longest.get(s[i], 0)
            if s[i] not in score and here + self.unknown > best[i + 1]:
                best[i + 1], back[i + 1] = here + self.unknown, i
            for j in range(i + 1, min(i + reach, size) + 1):
                v = score.get(s[i:j])
                if v is not None and here + v > best[j]:
                    best[j], back[j] = here + v, i
        return best, back

    def trace(self, s: str, back: list[int], end: int) -> tuple[int, list[int]]:
        """Where the path to ``end`` came in, and its pieces."""
        out = []
        while back[end] >= 0:
            start = back[end]
            i = self.id.get(s[start:end])
            out.append([i] if i is not None else
                       [self.spelled[b] for b in s[start:end].encode()])
            end = start
        return end, [i for part in reversed(out) for i in part]

    def unit(self, s: str) -> tuple[float, bytes]:
        """Score and pieces (32-bit integers) of a unit met by ``know``."""
        return self.memo[s]

    def know(self, units: set[str]) -> None:
        """Have all these units in the memory of words."""
        new = {u for u in units if u not in self.memo}
        if len(self.memo) + len(new) > MEMO:
            # The older half goes; what this batch needs of it is learnt again.
            for old in list(islice(self.memo, len(self.memo) // 2 + 1)):
                del self.memo[old]
            if len(self.memo) + len(units) > MEMO:
                self.memo.clear()
            new = {u for u in units if u not in self.memo}
        self.learn(sorted(new))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The pieces of each text, as 32-bit integers."""
        split = [self.units.findall(" " + t) if t else [] for t in texts]
        self.know({u for units in split for u in units})
        return [b"".join([self.memo[u][1] for u in units]) for units in split]

    def learn(self, units: list[str]) -> None:
        """Segment distinct units, many at once."""
        at, size = 0, 0
        for i, u in enumerate(units):
            size += len(u)
            if size >= BATCH_CHARS or i == len(units) - 1:
                self.memo.update(zip(units[at:i + 1], self.segmented(units[at:i + 1])))
                at, size = i + 1, 0

    def segmented(self, units: list[str]) -> list[tuple[float, bytes]]:
        """The search of ``best`` and ``trace`` in arrays over all units.

        Places count 0 to length in each unit.  Pieces are found by growing
        prefixes, only where some piece has them; the search then goes from
        place to place in all units at the same time.
        """
        chars = np.frombuffer("".join(units).encode("utf-32-le"), "<u4").astype(np.uint64)
        size = np.fromiter(map(len, units), np.int64, len(units))
        first = np.cumsum(size) - size
        unit = np.repeat(np.arange(len(units)), size)
        offset = np.arange(len(chars)) - first[unit]
        zero = first + np.arange(len(units))  # where a unit's places begin
        place, room = zero[unit] + offset, (size[unit] - offset)
        starts, lengths, ids, scores = [], [], [], []
        alive, h = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        for n, (keys, id_of, score_of) in enumerate(self.prefixes, 1):
            h = h * PREFIX_BASE + chars[alive + n - 1] + np.uint64(1)
            key = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            known = keys[key] == h
            if n == 1:  # a character that is no piece is spelled in bytes
                single = known & (id_of[key] >= 0)
                other = alive[~single]
                starts.append(other)
                lengths.append(np.ones(len(other), np.int64))
                ids.append(-1 - chars[other].astype(np.int64))
                scores.append(np.full(len(other), self.unknown))
            alive, h, key = alive[known], h[known], key[known]
            whole = id_of[key] >= 0
            starts.append(alive[whole])
            lengths.append(np.full(len(starts[-1]), n))
            ids.append(id_of[key][whole])
            scores.append(score_of[key][whole])
            more = room[alive] > n
            alive, h = alive[more], h[more]
            if not len(alive):
                break
        start, length, piece, score = map(np.concatenate, (starts, lengths, ids, scores))
        order = np.argsort(offset[start], kind="stable")
        begin = place[start][order]
        end, length, piece, score = (
            begin + length[order], length[order], piece[order], score[order])
        steps = np.searchsorted(offset[start][order], np.arange(int(size.max()) + 1))
        best = np.full(len(chars) + len(units), NEVER)
        best[zero] = 0.0
        last = np.full(len(best), -1)
        for a, b in zip(steps[:-1].tolist(), steps[1:].tolist()):
            # Pieces that start at one offset end at different places.
            reached = best[begin[a:b]] + score[a:b]
            better = np.flatnonzero(reached > best[end[a:b]]) + a
            best[end[better]] = reached[better - a]
            last[end[better]] = better
        at, who, found, owner = zero + size, np.arange(len(units)), [], []
        while len(at):
            edge = last[at]
            found.append(piece[edge])
            owner.append(who)
            at = at - length[edge]
            going = at > zero[who]
            at, who = at[going], who[going]
        found, owner = np.concatenate(found[::-1]), np.concatenate(owner[::-1])
        found = found[np.argsort(owner, kind="stable")]
        count = np.bincount(owner, minlength=len(units))
        data, ends = found.astype("<i4").tobytes(), np.cumsum(count)
        spelled = np.bincount(owner[np.argsort(owner, kind="stable")][found < 0],
                              minlength=len(units)) if (found < 0).any() else None
        out = []
        for i, (x, y, total) in enumerate(zip(
                (ends - count).tolist(), ends.tolist(), best[zero + size].tolist())):
            if spelled is not None and spelled[i]:
                some = [[p] if p >= 0 else [self.spelled[b] for b in chr(-1 - p).encode()]
                        for p in found[x:y].tolist()]
                out.append((total, np.array([p for q in some for p in q], "<i4").tobytes()))
            else:
                out.append((total, data[4 * x:4 * y]))
        return out

    def prefix_tables(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length: hashes of all prefixes of pieces, sorted, with the id
        (-1 if no piece) and the score."""
        tables: list[dict] = [{} for _ in range(self.states)]
        for p, i in self.id.items():
            h = 0
            for n, c in enumerate(p, 1):
                h = (h * int(PREFIX_BASE) + ord(c) + 1) % (1 << 64)
                if n == len(p):
                    tables[n - 1][h] = (i, self.score[p])
                else:
                    tables[n - 1].setdefault(h, (-1, 0.0))
        out = []
        for table in tables:
            keys = np.array(sorted(table), np.uint64)
            out.append((keys, np.array([table[int(k)][0] for k in keys], np.int64),
                        np.array([table[int(k)][1] for k in keys], float)))
        return out

    def parts(self, s: str, n: int):
        """Head, whole units, and tail of a chunk of ``n`` characters (``s`` also
        has the characters that a piece across the right edge may cover)."""
        found = [m.span() for m in self.units.finditer(s) if m.start() < n]
        head = found[0]
        tail = found[-1] if found[-1][1] > n else None
        if tail == head:
            return None, [], head
        middle = [s[a:b] for a, b in (found[1:-1] if tail else found[1:])]
        self.know(set(middle))
        return head, middle, tail

    def matrix(self, s: str, n: int) -> np.ndarray:
        """Best score from each left state to each right state."""
        size = self.states
        out = np.full((size, size), NEVER)
        head, middle, tail = self.parts(s, n)
        exits = None
        if head:
            fixed = sum(self.unit(u)[0] for u in middle)
            exits = self.exits(s[tail[0]:], n - tail[0], [0.0]) if tail else [0.0]
        for k in range(min(size, n + 1)):
            entry = [NEVER] * k + [0.0]
            if head is None:
                row = self.exits(s, n, entry)
            elif k <= head[1]:
                through = self.best(s[:head[1]], head[1], entry)[0][head[1]]
                row = [through + fixed + x for x in exits]
            else:
                continue
            out[k, :len(row)] = row
        return out

    def exits(self, s: str, n: int, entry: list[float]) -> list[float]:
        return self.best(s, n, entry)[0][n:n + self.states]

    def paths(self, s: str, n: int, entry: list[float]):
        """For each right state: its left state and pieces, as a function."""
        head, middle, tail = self.parts(s, n)
        if head is None:
            best, back = self.best(s, n, entry)
            return best[n:n + self.states], lambda j: self.trace(s, back, n + j)
        best, back = self.best(s[:head[1]], head[1], entry)
        start, first = self.trace(s[:head[1]], back, head[1])
        whole = b"".join(self.unit(u)[1] for u in middle)
        ids = first + np.frombuffer(whole, "<i4").tolist()
        if not tail:
            return [best[head[1]]], lambda j: (start, ids)
        end = s[tail[0]:]
        last, last_back = self.best(end, n - tail[0], [0.0])
        return (last[n - tail[0]:][:self.states],
                lambda j: (start, ids + self.trace(end, last_back, n - tail[0] + j)[1]))


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product, its greatest entry shifted to 0."""
    return level((a[:, :, None] + b[None, :, :]).max(axis=1))


def level(x: np.ndarray) -> np.ndarray:
    top = x.max()
    return x - top if top > NEVER else x


def doubles(x) -> bytes:
    return np.asarray(x, "<f8").tobytes()


def array(x: bytes, states: int) -> np.ndarray:
    return np.frombuffer(x, "<f8").reshape(-1, states)


ROW = ["doc_id", "text_key"]
KEY = "doc_id long, text_key long"


def chunks_of(giants: DataFrame, chunk: int, states: int) -> DataFrame:
    """Rows doc_id, text_key, seq, block, last, n, part of each giant text."""
    def cut(batches):
        for batch in frames.slices(batches):
            ids, keys, bodies = (batch.column(i).to_pylist() for i in range(3))
            for doc, key, text in zip(ids, keys, bodies):
                s = " " + text
                count = -(-len(s) // chunk)
                for c in range(count):
                    part = s[c * chunk:(c + 1) * chunk + states - 1]
                    n = min(chunk, len(s) - c * chunk)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x], k) for x, k in (
                            (doc, pa.int64()), (key, pa.int64()), (c, pa.int64()),
                            (c // FAN, pa.int64()), (c == count - 1, pa.bool_()),
                            (n, pa.int64()), (part, pa.string()))],
                        ["doc_id", "text_key", "seq", "block", "last", "n", "part"])

    return giants.mapInArrow(cut, f"{KEY}, seq long, block long, last boolean, n long, part string")


def grouped(rows: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    return rows.groupBy(*keys).applyInPandas(work, schema)


def left_scores(matrices: DataFrame, states: int) -> DataFrame:
    """doc_id, text_key, seq, entry: the scores at every chunk's left edge."""
    def product(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq")
        total = None
        for m in part["matrix"]:
            total = array(m, states) if total is None else times(total, array(m, states))
        return part.head(1)[[*ROW, "block"]].assign(matrix=doubles(total))

    def scan(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block")
        v, out = np.full((1, states), NEVER), []
        v[0, 0] = 0.0
        for m in part["matrix"]:
            out.append(doubles(v))
            v = times(v, array(m, states))
        return part[[*ROW, "block"]].assign(entry=out)

    def within(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq")
        v, out = array(part["entry"].iloc[0], states), []
        for m in part["matrix"]:
            out.append(doubles(v))
            v = times(v, array(m, states))
        return part[[*ROW, "seq"]].assign(entry=out)

    keys = [*ROW, "block"]
    products = grouped(matrices, keys, product, f"{KEY}, block long, matrix binary")
    starts = grouped(products, ROW, scan, f"{KEY}, block long, entry binary")
    return grouped(same_rows(matrices, starts, keys), keys, within, f"{KEY}, seq long, entry binary")


def right_states(maps: DataFrame) -> DataFrame:
    """doc_id, text_key, seq, state: the state at every chunk's right edge."""
    def composed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq", ascending=False)
        total = None
        for m in part["left"]:
            m = np.asarray(m)
            total = m if total is None else m[total]  # right states of the block to left ones
        return part.head(1)[[*ROW, "block"]].assign(left=[total.tolist()])

    def scan(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block", ascending=False)
        state, out = 0, []
        for m in part["left"]:
            out.append(state)
            state = int(m[state])
        return part[[*ROW, "block"]].assign(state=out)

    def within(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq", ascending=False)
        state, out = int(part["state"].iloc[0]), []
        for m in part["left"]:
            out.append(state)
            state = int(m[state])
        return part[[*ROW, "seq"]].assign(state=out)

    keys = [*ROW, "block"]
    blocks = grouped(maps, keys, composed, f"{KEY}, block long, left array<int>")
    ends = grouped(blocks, ROW, scan, f"{KEY}, block long, state int")
    return grouped(same_rows(maps, ends, keys), keys, within, f"{KEY}, seq long, state int")


def same_rows(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Join on keys that may be null."""
    b = b.select(*[F.col(k).alias(f"_{k}") for k in keys],
                 *[c for c in b.columns if c not in keys])
    same = None
    for k in keys:
        one = a[k].eqNullSafe(b[f"_{k}"])
        same = one if same is None else same & one
    return a.join(b, same).drop(*[f"_{k}" for k in keys])


def encode_giants(giants: DataFrame, shared, chunk: int, states: int) -> DataFrame:
    """doc_id, text_key, ids of distinct giant texts."""
    chunks = frames.staged(chunks_of(giants, chunk, states))

    def values(batch, *names):
        return zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names))

    def to_matrix(batch):
        use = segmenter(shared)
        return {"matrix": [doubles(use.matrix(s, n)) for s, n in values(batch, "part", "n")]}

    def to_map(batch):
        use, out = segmenter(shared), []
        for s, n, entry in values(batch, "part", "n", "entry"):
            reached, path = use.paths(s, n, array(entry, states)[0].tolist())
            out.append([path(j)[0] if v > NEVER else 0 for j, v in enumerate(reached)]
                       + [0] * (states - len(reached)))
        return {"left": out}

    def to_ids(batch):
        use, out = segmenter(shared), []
        for s, n, entry, state in values(batch, "part", "n", "entry", "state"):
            out.append(use.paths(s, n, array(entry, states)[0].tolist())[1](state)[1])
        return {"ids": out}

    at = (*ROW, "seq")
    matrices = frames.staged(frames.arrow_map(
        chunks.repartition(*at), to_matrix, "matrix binary", (*at, "block")))
    entries = frames.staged(left_scores(matrices, states))
    maps = frames.staged(frames.arrow_map(
        same_rows(chunks, entries, list(at)), to_map, "left array<int>", (*at, "block")))
    ends = same_rows(entries, right_states(maps), list(at))
    done = frames.arrow_map(same_rows(chunks, ends, list(at)), to_ids, "ids array<int>", at)
    return done.groupBy(*ROW).agg(F.expr(
        "flatten(transform(array_sort(collect_list(struct(seq, ids))), x -> x.ids))").alias("ids"))


def segmenter(shared) -> Segmenter:
    """The worker's segmenter, kept beside the broadcast vocabulary it reads, so
    that later tasks of the worker find its memory of words."""
    words = shared.value
    if "segmenter" not in words:
        words["segmenter"] = Segmenter(words)
    return words["segmenter"]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           model: str = MODEL, chunk: int = CHUNK, verify: bool = False) -> DataFrame:
    """doc_id, ids: the pieces of every text; with ``verify`` also n_pieces, and
    whether they decode to the text (lossless), found by the task that has both."""
    spark = docs.sparkSession
    words = vocabulary(model)
    states = Segmenter(words).states
    if chunk < states:
        raise ValueError("a chunk must be longer than the longest piece")
    shared = spark.sparkContext.broadcast(words)
    texts = frames.keyed_texts(docs, id_col, text_col)
    giant = F.coalesce(F.length("text") > chunk, F.lit(False))

    def small(batches):
        use, table = segmenter(shared), byte_table(shared.value)
        for batch in frames.slices(batches):
            bodies = frames.texts(batch)
            found = use.encode([t.decode("utf-8", "replace") for t in bodies])
            sizes = [len(x) // 4 for x in found]
            ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
            ids = pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))
            same = [decode_ids(np.frombuffer(x, "<i4"), table) == t
                    for x, t in zip(found, bodies)] if verify else [None] * len(bodies)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), ids, pa.array(sizes, pa.int64()), pa.array(same, pa.bool_())],
                ["doc_id", *CHECKED])

    columns = ["doc_id", *(CHECKED if verify else CHECKED[:1])]
    out = texts.filter(~giant).mapInArrow(
        small, "doc_id long, ids array<int>, n_pieces long, lossless boolean").select(*columns)
    big = frames.arrow_map(
        texts.filter(giant), lambda b: {
            "text_key": [signed(xxhash.xxh3_64_intdigest(x)) for x in frames.texts(b)]},
        "text_key long", ("doc_id", "text"))
    big = frames.staged(big.select("doc_id", "text_key", "text"))
    if big.isEmpty():
        return out
    encoded = encode_giants(big.dropDuplicates(ROW), shared, chunk, states)
    if verify:
        encoded = verified(encoded, shared)
    return out.unionByName(same_rows(big.select(*ROW), encoded, ROW).select(*columns))


CHECKED = ["ids", "n_pieces", "lossless"]


def verified(encoded: DataFrame, shared) -> DataFrame:
    """Of distinct texts: whether the pieces decode to a text with the key."""
    def work(batch):
        table = byte_table(shared.value)
        ids = [np.asarray(x.values, "<i4") for x in batch.column(batch.schema.get_field_index("ids"))]
        keys = batch.column(batch.schema.get_field_index("text_key")).to_pylist()
        return {"n_pieces": [len(x) for x in ids], "lossless": [
            signed(xxhash.xxh3_64_intdigest(decode_ids(x, table))) == k for x, k in zip(ids, keys)]}

    return frames.arrow_map(encoded, work, "n_pieces long, lossless boolean", (*ROW, "ids"))


def decode_ids(ids: np.ndarray, table: list[bytes]) -> bytes:
    return b"".join([table[i] for i in ids.tolist()])[1:]


def byte_table(words: dict) -> list[bytes]:
    """The bytes of each piece (kept beside the vocabulary)."""
    if "table" in words:
        return words["table"]
    table = words["table"] = [b""] * words["size"]
    for piece, (i, _) in words["pieces"].items():
        table[i] = piece.encode()
    for b, i in enumerate(words["bytes"]):
        table[i] = bytes([b])
    return table


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``encoded`` with the decoded text, n_pieces and the digest of the ids (as
    little-endian 32-bit integers)."""
    words = vocabulary(model)
    shared = encoded.sparkSession.sparkContext.broadcast(byte_table(words))

    def work(batch):
        ids = batch.column(batch.schema.get_field_index("ids"))
        rows = [np.asarray(x.values, "<i4") for x in ids]
        return {"decoded": [decode_ids(x, shared.value).decode("utf-8", "replace") for x in rows],
                "n_pieces": [len(x) for x in rows],
                "ids_sha256": [hashlib.sha256(x.tobytes()).hexdigest() for x in rows]}

    return frames.arrow_map(encoded, work, "decoded string, n_pieces long, ids_sha256 string",
                            tuple(encoded.columns))


def report(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", "n_pieces", "ids_sha256",
                          F.length("decoded").cast("long").alias("n_chars"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))
