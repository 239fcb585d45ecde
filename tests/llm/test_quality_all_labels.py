"""Every trusted document counts, and the quantile is exact."""

import numpy as np
import pytest

from touchline.llm import quality


def test_no_bound_on_trusted_documents(spark):
    n = 25_000
    rows = spark.range(n).selectExpr("id AS doc_id", "concat('word', id) AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    target, held_out = quality.trusted_ids(labels)
    assert len(target) + len(held_out) == n and 0.18 * n < len(held_out) < 0.22 * n
    seen = quality.marked(rows, labels).groupBy("held_out").count().collect()
    assert {r[0]: r[1] for r in seen} == {False: len(target), True: len(held_out)}


def test_marked_rows(spark):
    docs = spark.createDataFrame([(0, "a"), (0, "a"), (None, "b"), (None, None), (7, "c")],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (None, 1, 0), (7, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    got = sorted((r.text or "", r.held_out is None) for r in quality.marked(docs, labels).collect())
    assert got == [("", True), ("a", False), ("a", False), ("b", True), ("c", True)]


@pytest.mark.parametrize("same", [False, True])
def test_quantile(spark, monkeypatch, same):
    monkeypatch.setattr(quality, "FEW", 10)
    monkeypatch.setattr(quality, "RANGES", 4)
    draw = np.random.default_rng(1).normal(size=3_001)
    values = np.repeat(draw[:3], 900) if same else np.concatenate([draw, [-1e6, 1e6]])
    df = spark.createDataFrame([(float(v),) for v in values], "score double")
    assert quality.low_quantile(df) == np.quantile(values, quality.QUANTILE, method="lower")
    assert quality.low_quantile(df.limit(0)) is None
