"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL

from touchline.llm import collocations


def plain(docs, least=10, share=50, top=2_000):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                for at in range(len(words) - size + 1):
                    f[lang, tuple(words[at:at + size])] += 1
    wanted = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    rows = []
    for (lang, words), a in wanted.items():
        if any(100 * b >= share * a and any(other[i:i + len(words)] == words
                                            for i in range(len(other) - len(words) + 1))
               for (tongue, other), b in wanted.items()
               if tongue == lang and len(other) > len(words)):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k)
                for k in range(1, len(words))]
        score, k = min(cuts)
        rows.append((lang, " ".join(words), a, f[lang, words[:k]], f[lang, words[k:]], n[lang], score))
    out = []
    for lang in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == lang),
                      key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i + 1, *r[1:]) for i, r in enumerate(mine[:top])]
    return sorted(out)


def random_docs():
    rng = random.Random(5)
    words = ["new", "york", "City", "the", "of", "é", "Ünï", "a.b", "x\x00y", "\u3000", "w\x1cv"] + [
        f"v{i}" for i in range(6)]
    docs = [("en", None), (None, "one null lang"), ("en", ""), ("fr", " .,;\t\n"), (None, None)]
    for i in range(150):
        body = [rng.choice(words) for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(4)):
            body[rng.randrange(len(body) + 1):0] = ["New", "York", "City"]
        lang = rng.choice(["en", "en", "fr", None, ""])
        docs.append((lang, rng.choice([" ", "  ", "\t"]).join(
            x + rng.choice(["", "", "", ".", ",", "\r\n", "!"]) for x in body)))
    docs += [docs[-1]] * 15 + [("en", "the " * 3_000 + "end")]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(lang, text, 1, ["x"], 2.0, 3) for lang, text in docs],
                                 "lang string, text string, f int, w1 array<string>, phrase double, size int")


# Parts of a few bytes cut texts anywhere; a bitmap of 64 bits marks nearly all pairs.
@pytest.mark.parametrize("part, bits, held, spread", [
    (collocations.PART, collocations.BITS, collocations.HELD, collocations.COPIES),
    (40, 64, 10, 2)])
def test_random_tables(spark, monkeypatch, part, bits, held, spread):
    monkeypatch.setattr(collocations, "PART", part)
    monkeypatch.setattr(collocations, "BITS", bits)
    monkeypatch.setattr(collocations, "HELD", held)
    monkeypatch.setattr(collocations, "COPIES", spread)
    docs = random_docs()
    want = plain(docs)
    got = collocations.collocations(frame(spark, docs))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == want
    assert len({r[0] for r in want}) == 4 and len(want) > 15
    few = collocations.collocations(frame(spark, docs), least=4, share=80, top=7)
    assert sorted(map(tuple, few.collect())) == plain(docs, 4, 80, 7)


def test_common_parts_are_spread(spark, monkeypatch):
    """One word starts nearly all candidates."""
    monkeypatch.setattr(collocations, "COPIES", 3)
    docs = [("en", f"the v{i % 40}. rare u{i}") for i in range(800)]
    assert sorted(map(tuple, collocations.collocations(frame(spark, docs)).collect())) == plain(docs)


def test_windows_are_summed_before_the_rollup(spark):
    """Tasks hold the same windows: each comes once, and a rare one without its last word."""
    texts = spark.createDataFrame([("en", "a b c. a b d a b d")] * 8, "lang string, text string")
    texts = texts.union(spark.createDataFrame([("en", "a b rare")], texts.schema)).repartition(6)
    every = np.full(collocations.BITS // 64, ~np.uint64(0))
    got, want, full = Counter(), Counter(), []
    for lang, *words, f in collocations.longest_windows(texts, every).collect():
        got[tuple(words)] += f
        full += [tuple(words)] if words[2] else []
    for text, f in (("a b c", 8), ("a b d a b d", 8), ("a b rare", 1)):
        words = text.split()
        for at in range(len(words)):
            want[tuple((words[at:at + 3] + [None] * 2)[:3])] += f
    for words in [w for w in want if want[w] < 10 and w[2]]:
        want[*words[:2], None] += want.pop(words)
    assert got == want
    assert sorted(full) == [("a", "b", "d")] and got["a", "b", "d"] == 16


def test_windows_move_packed(spark):
    """Far fewer bytes than the words of the windows have."""
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").select("lang", "text").coalesce(2)
    every = np.full(collocations.BITS // 64, ~np.uint64(0))
    rows = collocations.packed_windows(texts, every, 2).collect()
    moved, plain_ = sum(len(r.data) for r in rows), 0
    for r in rows:
        words, columns, times = collocations.unpack(r.size, r.length, r.data)
        plain_ += 8 * len(times) + sum(len(words[c]) for column in columns for c in column if c >= 0)
    assert len(rows) <= 2 * 2 * len({r.lang for r in rows})
    assert 3 * moved < plain_


def test_exact_products(spark):
    """Counts whose products pass 64 bits."""
    big = 10 ** 14
    counts = spark.createDataFrame(
        [("en", 0, "", 9 * big), ("en", 1, "a", 3 * big + 1), ("en", 1, "b", 2 * big + 7),
         ("en", 2, "a b", 2 * big - 1)], "lang string, size int, phrase string, f long")
    score = 1_000_000 * (2 * big - 1) ** 2 // ((3 * big + 1) * (2 * big + 7))
    assert collocations.scored(counts).first()["score"] == score


def test_given_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = plain([(r.lang, r.text) for r in docs.collect()])
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == want


def test_empty(spark):
    docs = frame(spark, [("en", "a b")])
    assert collocations.collocations(docs).collect() == []
    assert collocations.collocations(docs.limit(0)).collect() == []
