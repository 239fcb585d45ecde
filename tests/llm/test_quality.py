"""Quality rules against a plain count, and the model on held-out labels."""

import random
import re
from collections import Counter

import numpy as np
from conftest import SMALL

from touchline.llm import quality
from touchline.llm import words as w


def plain(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = Counter(tuple(found[i:i + 8]) for i in range(len(found) - 7))
    inside = {j for i in range(len(found) - 7) if wins[tuple(found[i:i + 8])] > 1
              for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(found)
    return (n, sum(map(len, found)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(inside), n < 20 or 100 * len(inside) > 30 * n)


def judged(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, kept int")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return docs, table, quality.quality_rules(docs, table).collect()


def test_counts(spark):
    rng = random.Random(1)
    rows = [(None, None), (1, ""), (2, " \n\t\n"), (3, "é # b\nb\n b\nb\x0b"), (3, "é # b\nb\n b\nb\x0b")]
    for i in range(40):
        body = [rng.choice(["a", "bé", "c#", "d", "x" * 9, "日本"]) for _ in range(rng.randrange(120))]
        rows.append((10 + i, "".join(x + rng.choice([" ", "\n", "  ", "\t"]) for x in body)))
    rows.append((99, "word " * 50_000 + "\n" * 10))
    docs, table, got = judged(spark, rows, [(10, 1, 0), (11, 0, 0), (None, 1, 0)])
    assert sorted((str(r.doc_id), *r[1:7]) for r in got) == sorted(
        (str(d), *plain(t)) for d, t in rows)
    assert not any(r.base_failed and r.kept for r in got)


def plain_scores(rows, trusted):
    """The log-likelihood ratio from counts in dictionaries."""
    def grams(text):
        line = " ".join((text or "").split()).encode()
        return [int.from_bytes(line[i:i + 5], "big") * w.BASE % (1 << 64) >> 48
                for i in range(len(line) - 4)]

    raw, target, size = Counter(), Counter(), 1 << 16
    for d, t in rows:
        raw.update(grams(t))
        if d in trusted:
            target.update(grams(t))
    n, m = sum(raw.values()), sum(target.values())
    out = {}
    for d, t in rows:
        terms = []
        for b in grams(t):
            p = (raw[b] + quality.PRIOR) / (n + quality.PRIOR * size)
            q = (target[b] + quality.PRIOR * size * p) / (m + quality.PRIOR * size)
            terms.append(np.log(q / p))
        out[d] = float(np.mean(terms)) if terms else 0.0
    return out


def test_scores(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    target, held_out = quality.trusted_ids(labels)
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and r.toxic == 0}
    assert set(target) | set(held_out) == good and not set(target) & set(held_out)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, got = plain_scores(rows, set(target)), quality.quality_rules(docs, labels).collect()
    limit = np.quantile([want[d] for d, t in rows if d in held_out and len(t.split()) >= 20],
                        quality.QUANTILE, method="lower") - quality.MARGIN
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.score - want[r.doc_id]) < 1e-9
        assert r.kept == (not r.base_failed and want[r.doc_id] >= limit)
    kept = {r.doc_id for r in got if r.kept}
    stayed = quality.keep_good(docs.withColumn("_kept", docs.doc_id), labels)
    assert stayed.columns == [*docs.columns, "_kept"]
    assert {r.doc_id for r in stayed.collect()} == kept
    assert quality.score_of([b"abc", b"defgh"], np.arange(1 << 16)) == np.mean(
        [x for piece in quality.grams([b"abc", b"defgh"]) for x in piece])
    long = [b"word%d" % i for i in range(5000)]
    whole = np.concatenate(list(quality.grams(long)))
    monkeypatch.setattr(quality, "PIECE", 1000)
    assert (np.concatenate(list(quality.grams(long))) == whole).all()


def test_held_out_labels(spark):
    """Fitted on half of the labels, the verdicts hold on the other half."""
    docs = spark.read.parquet(f"/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet(f"/root/testdata/sf0.1/labels.parquet")
    got = (quality.quality_rules(docs, labels.filter("doc_id % 2 = 0"))
           .join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("NOT base_failed").collect())
    good = [r.kept for r in got if r.quality == 1]
    bad = [r.kept for r in got if r.quality == 0]
    assert len(good) > 500 and np.mean(good) > 0.98
    assert len(bad) > 50 and np.mean(bad) < 0.1


def test_empty(spark):
    docs, table, got = judged(spark, [], [])
    assert got == [] and quality.keep_good(docs, table).collect() == []
    _, _, got = judged(spark, [(1, "some words " * 30)], [])
    assert got[0].score == 0.0
