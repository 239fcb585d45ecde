"""Removed words against a dictionary of all windows."""

import hashlib
import random

import numpy as np
import pytest
from conftest import SMALL

from touchline.llm import substrings
from touchline.llm import words as w


def plain(rows, window):
    first, order = {}, lambda d: substrings.LAST if d is None else d
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, found in split:
        for i in range(len(found) - window + 1):
            key = tuple(found[i:i + window])
            first[key] = min(order(d), first.get(key, order(d)))
    out = []
    for d, found in split:
        gone = set()
        for i in range(len(found) - window + 1):
            if first[tuple(found[i:i + window])] < order(d):
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(found) if i not in gone)
        out.append((d, len(found), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows],
                                 "doc_id long, text string, kept string, start int")
    got = substrings.report(substrings.drop_repeats(docs, **options))
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("options", [
    {}, {"crowded": 3}, {"bucket_bytes": 2000}, {"window": 5, "mer": 2, "crowded": 1},
    {"window": 3, "mer": 3}])
def test_odd_rows(spark, options):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(200)] + ["été", "日本"]
    passages = [[rng.choice(vocabulary) for _ in range(n)] for n in (49, 50, 51, 60, 120, 400)]
    rows = [(None, None), (None, " ".join(passages[4])), (None, " ".join(passages[4])), (1, ""),
            (2, " \n"), (90, " ".join(passages[3])), (90, "x " + " ".join(passages[3])),
            (5, "a " * 300), (6, "a " * 120 + "b")]
    for d in range(40):
        body = [rng.choice(vocabulary) for _ in range(rng.randrange(150))]
        for p in rng.sample(passages, rng.randrange(3)):
            at = rng.randrange(len(body) + 1)
            body[at:at] = p
        rows.append((100 - d, rng.choice([" ", "\n", "  \t"]).join(body)))
    rows += [rows[-1], (300, " ".join(rng.choice(vocabulary) for _ in range(30_000)))]
    assert found(spark, rows, **options) == plain(rows, options.get("window", 50))


def test_given_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = substrings.report(substrings.drop_repeats(docs))
    want = plain(rows, 50)
    assert sorted(map(tuple, got.collect()), key=str) == want and any(r[2] for r in want)


def test_super_kmers():
    rng = random.Random(1)
    texts = [b" ".join(b"%d" % rng.randrange(5) for _ in range(n)) for n in (300, 0, 49, 50, 4, 120)]
    for window, mer in ((50, 8), (10, 3), (4, 4)):
        runs, at = substrings.Runs(texts, window, mer), 0
        for d, text in enumerate(texts):
            h = w.hashes(text.split())
            value = w.mix(w.rolling(h, mer)).tolist()
            best = [min(range(i, i + window - mer + 1), key=lambda j: (value[j], j))
                    for i in range(len(h) - window + 1)]
            mine = runs.doc == d
            start, count = runs.start[mine], runs.count[mine]
            assert count.sum() == len(best) and (np.cumsum(count) - count == start).all()
            assert [value[b] for b in best] == np.repeat(runs.value[mine], count).tolist()
            assert mine.sum() == (1 + sum(a != b for a, b in zip(best, best[1:])) if best else 0)
            assert (runs.first[mine] == start + at).all()
            at += len(h)


def test_equal_hashes_of_other_windows(monkeypatch):
    """Should hashes collide, the words decide."""
    bodies = [b"a b c d", b"x y z d", b"a b c e"]
    meta = np.array([(1, 0, 0, 2), (2, 0, 0, 2), (3, 0, 0, 2)])

    def spans():
        return substrings.repeated(meta, bodies, 3).to_pylist()

    assert spans() == [{"doc_id": 3, "text_key": 0, "start": 0, "end": 3}]
    monkeypatch.setattr(w, "hashes", lambda found: np.zeros(len(found), np.uint64))
    assert spans() == [{"doc_id": 3, "text_key": 0, "start": 0, "end": 3}]


def test_empty(spark):
    assert found(spark, []) == []
