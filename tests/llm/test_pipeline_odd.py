"""The pipeline's stages on nulls, repeated rows, ties, long texts and clashing names."""

import random

from test_simhash import plain_classes, plain_fingerprint

import corpus_pipeline
from touchline.llm import decontaminate, frames, quality, simhash

EXTRA = ("key string, _key long, kept boolean, fp long, root string, row int, bits binary, "
         "_maybe int, text_key long, marks map<string,int>, _at int")
RNG = random.Random(4)
VOCABULARY = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("a", "on", "et", "ing", "or", "us")]


def prose(words):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(words))


def write(spark, folder, rows, labels, items):
    extra = ("k", 1, True, 2, "r", 3, bytearray(b"b"), 4, 5, {"a": 1}, 6)
    docs = spark.createDataFrame(
        [(i, t, "en", "s", len(t or ""), *extra) for i, t in rows],
        f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_odd_rows(spark, tmp_path):
    folder = str(tmp_path)
    texts = [(i, prose(60)) for i in range(60)]
    passage = prose(40)
    near = texts[7][1].rsplit(" ", 1)[0]
    rows = texts + [texts[3]] * 4 + [(200, texts[5][1]), (None, texts[6][1]), (None, prose(50)), (61, None),
                                     (62, ""), (63, "few words"), (64, near), (65, passage),
                                     (66, prose(30) + " token=abcdefgh12 " + prose(30)), (None, None),
                                     (67, prose(40_000)), (5, prose(60)), (5, texts[8][1])]
    labels = [(i, 1, 0) for i in range(60)] * 2 + [(None, 1, 0), (61, 1, 0), (65, 1, 1)]
    docs = write(spark, folder, rows, labels, [(1, passage), (2, None)])
    good = {(i, t) for i, t in rows if t and len(t.split()) >= 20}
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "sentencepiece":
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        found = docs.collect()
        sizes.append(len(found))
        if name == "quality_rules":
            assert {(r.doc_id, r.text) for r in found} == good
            assert sum(r.doc_id == 3 for r in found) == 5
        if name == "simhash_near_duplicates":
            classes = plain_classes([(t, plain_fingerprint(t)) for _, t in good])
            assert len(found) == len({c for _, _, c in classes})
            assert sum(r.doc_id == 3 for r in found) == 1
            assert {r.doc_id for r in found} >= {*range(60)} - {5, 8}
            assert 200 not in {r.doc_id for r in found}
            assert all(r.marks == {"a": 1} and r.key == "k" for r in found)
        if name == "benchmark_decontamination":
            assert 65 not in {r.doc_id for r in found}
        if name == "secret_scans":
            assert [r.text.count("<secret>") for r in found if r.doc_id == 66] == [1]
    assert sizes[1] == sizes[2] + 1 and sizes[2] == sizes[3] == sizes[4]
    assert all(r.lossless for r in docs.collect())


def test_kept_rows_do_not_depend_on_the_order(spark):
    """Rows of one id and text that differ elsewhere: the same one stays."""
    rows = [(1, "a b c d e", x) for x in range(20)] + [(None, "a b c d e", 3), (2, "x y z", 1)] * 2
    kept = []
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string, key int").repartition(seed + 1)
        kept.append(sorted(map(tuple, simhash.keep_one(df).collect())))
    assert kept[0] == kept[1] == kept[2] and [r[0] for r in kept[0]] == [1, 2]


def test_only_rows_in_doubt_are_compared(spark, monkeypatch):
    """A bitmap of one row lets some kept rows through; the comparison is exact."""
    monkeypatch.setattr(frames, "KEY_BITS", frames.ROW_BITS)
    docs = spark.range(9_000).selectExpr("id AS doc_id", "concat('t', id % 4000) AS text", "id AS _key")
    lost = docs.filter("doc_id % 3 = 0").select(frames.text_key(docs).alias("key"))
    kept = frames.without(docs, frames.text_key(docs), frames.staged(lost))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(9_000) if i % 3]


def test_decontamination_in_blocks(spark):
    """Several passes drop the same rows as one."""
    docs = spark.createDataFrame(
        [(1, "a b c d"), (1, "x y z"), (None, "a b c d"), (2, None), (3, "q r s t")],
        "doc_id long, text string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c", "q r", "m n o p"])],
                                  "item_id long, text string")
    want = sorted(map(str, decontaminate.keep_clean(docs, bench).collect()))
    got = sorted(map(str, decontaminate.keep_clean(docs, bench, block_bytes=4).collect()))
    assert got == want and len(want) == 2


def test_scores_at_the_threshold_stay(spark):
    docs = spark.createDataFrame([(i, prose(30)) for i in range(20)], "doc_id long, text string")
    ratios = quality.log_ratios(docs, spark.createDataFrame(
        [(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int"))
    scores = {r.doc_id: r.score for r in quality.judge(docs, ratios, 0.0).collect()}
    limit = sorted(scores.values())[5]
    kept = {r.doc_id for r in quality.judge(docs, ratios, limit).collect() if r.kept}
    assert kept == {d for d, s in scores.items() if s >= limit}
