"""Every stage of the pipeline against a plain version of it."""

import numpy as np
from conftest import SMALL
from test_decontaminate import plain as plain_hits
from test_pieces import plain as plain_pieces
from test_quality import plain as plain_measures
from test_quality import plain_scores
from test_secrets import redact
from test_simhash import plain_classes, plain_fingerprint

import corpus_pipeline
from touchline.llm import quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_stages(rows, labels, items, target, held_out):
    """rows: doc_id -> row; what stays after each stage."""
    texts = [(d, r["text"]) for d, r in rows.items()]
    scores = plain_scores(texts, target)
    limit = np.quantile([scores[d] for d in held_out if len(rows[d]["text"].split()) >= 20],
                        quality.QUANTILE, method="lower") - quality.MARGIN
    good = {d: r for d, r in rows.items()
            if not plain_measures(r["text"])[-1] and scores[d] >= limit}
    yield good
    classes = plain_classes([(d, plain_fingerprint(r["text"])) for d, r in good.items()])
    single = {d: good[d] for d, _, c in classes if d == c}
    yield single
    clean = {r[0]: single[r[0]] for r in plain_hits(
        [(d, r["text"]) for d, r in single.items()], items) if not r[-1]}
    yield clean
    masked = {d: {**r, "text": (t := redact(r["text"])), "n_chars": len(t)} for d, r in clean.items()}
    yield masked


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r.doc_id: r.asDict() for r in docs.collect()}
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    target, held_out = quality.trusted_ids(labels)
    want = list(plain_stages(rows, labels, items, set(target), held_out))
    sizes = []
    for (name, stage), rest in zip(corpus_pipeline.STAGES, want):
        out = stage(spark, docs, SMALL)
        assert out.columns == COLUMNS and name
        assert {r.doc_id: r.asDict() for r in out.collect()} == rest
        sizes.append(len(rest))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert len(rows) > sizes[0] > sizes[1] >= sizes[2] == sizes[3] > 0
    last = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()}
    assert {d: r.ids for d, r in last.items()} == {
        d: plain_pieces(r["text"]) for d, r in want[-1].items()}
    assert all(r.lossless and r.n_pieces == len(r.ids) for r in last.values())


def test_run_and_empty(spark, tmp_path):
    whole = corpus_pipeline.run(spark, SMALL)
    assert whole.columns == ["doc_id", "ids", "n_pieces", "lossless"] and whole.count() > 50
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{table}.parquet").limit(0).write.parquet(
            str(tmp_path / f"{table}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
