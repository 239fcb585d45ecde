"""Trusted texts through a bitmap of ids, against a plain join."""

import pytest
from conftest import SMALL

from touchline.llm import frames, quality


def plain(docs, labels, held_out):
    rows = quality.marked(frames.keyed_texts(docs, "doc_id", "text"), labels)
    return sorted(r.text or "" for r in rows.collect() if r.held_out is held_out)


@pytest.mark.parametrize("bits", [frames.KEY_BITS, frames.ROW_BITS])
@pytest.mark.parametrize("held_out", [False, True])
def test_given_tables(spark, monkeypatch, bits, held_out):
    """A small bitmap lets some more documents through; the join is exact."""
    monkeypatch.setattr(frames, "KEY_BITS", bits)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    want = plain(docs, labels, held_out)
    got = quality.trusted_texts(frames.keyed_texts(docs, "doc_id", "text"), labels, held_out)
    assert sorted(r.text or "" for r in got.collect()) == want and want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Python" not in plan


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(i, f"t{i}") for i in range(50)] + [(3, "again"), (3, None), (None, "no id"), (-1, "below")],
        "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(-5, 40)] * 2 + [(None, 1, 0), (45, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    for held_out in (False, True):
        got = quality.trusted_texts(docs, labels, held_out)
        assert sorted(r.text or "" for r in got.collect()) == plain(docs, labels, held_out)
    none = quality.trusted_texts(docs, labels.limit(0), False)
    assert none.collect() == []
