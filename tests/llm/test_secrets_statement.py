"""The statement's rules on keys joined to patterns, samples and separators."""

import random

import compare
import duckdb

from touchline.llm import oracle, secrets


def test_statement_on_joined_keys(spark, tmp_path):
    rng = random.Random(12)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts = [None, "", "é" * 30]
    for _ in range(150):
        key = "".join(rng.choice(b64) for _ in range(rng.choice([20, 40])))
        low = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([24, 32, 40])))
        access = "AKIA" + "".join(rng.choice(b64[:26]) for _ in range(16))
        bits = [key, low, low.upper(), access, "token=", "EXAMPLE", b64[26:52], "0123456789", "word",
                "-", "/", "_", "=", " ", "é ", "id-"]
        texts.append("".join(rng.choice(bits) for _ in range(rng.randrange(2, 9))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = compare.check(spark, con, lambda s, d: secrets.report(secrets.find_secrets(df)),
                          oracle.SECRETS, "")
    assert found == ""


def test_long_runs_take_seconds(spark):
    """A megabyte of joined words and of key characters, and many spans in one text."""
    import time

    rng = random.Random(1)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    runs = {"words": "a-" * 500_000, "base64": "".join(rng.choices(b64, k=1_000_000)),
            "spans": "token=abcdefgh0 " * 5_000}
    for name, text in runs.items():
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        secrets.find_secrets(df.limit(0)).collect()
        start = time.perf_counter()
        clean = secrets.redacted(df).first().text
        spent = time.perf_counter() - start
        assert spent < 30, (name, spent)
        if name == "words":
            assert clean == text
        else:
            assert "<secret>" in clean and len(clean) < len(text) / 1.5
