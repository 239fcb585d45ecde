"""Containment of benchmark windows against a plain search."""

import hashlib
import random
import re

import pytest
from conftest import SMALL

from touchline.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items):
    out = []
    for doc_id, text in docs:
        found, hit, ids = words(text), set(), set()
        for item_id, body in items:
            item = words(body)
            n = min(13, len(item))
            wins = {tuple(item[i:i + n]) for i in range(len(item) - n + 1)} if n else set()
            for at in range(len(found) - n + 1 if n else 0):
                if tuple(found[at:at + n]) in wins:
                    hit.update(range(at, at + n))
                    ids.add("null" if item_id is None else str(item_id))
        joined = ",".join(sorted(ids))
        out.append((doc_id, len(found), len(hit), len(ids),
                    hashlib.sha256(joined.encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(found)))
    return sorted(out, key=str)


def random_tables():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)] + ["été", "Ünï", "a"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 12, 13, 14, 40]))))
             for i in range(25)]
    items += [(None, "one null item here"), (90, None), (91, " ... "), (3, items[5][1]),
              (92, items[4][1].upper())]
    docs = [(None, None), (None, "one null item here"), (1, ""), (2, "...")]
    for d in range(40):
        body = [rng.choice(vocabulary) for _ in range(rng.randrange(300))]
        if d % 3:
            at = rng.randrange(len(body) + 1)
            body[at:at] = (items[d % 25][1] or "").upper().split()
        docs.append((d // 2, rng.choice([" ", ", ", "\n-"]).join(body)))
    docs += [docs[-1], (77, "w1 " * 100_000)]
    return docs, items


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 500])
def test_random_tables(spark, block):
    docs, items = random_tables()
    df = spark.createDataFrame([(*d, 1, ["x"]) for d in docs],
                               "doc_id long, text string, n_words int, items array<string>")
    bench = spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, doc_id string")
    want = plain(docs, items)
    got = decontaminate.contamination(df, bench, block_bytes=block)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert any(r[-1] for r in want) and not all(r[-1] for r in want)
    kept = decontaminate.keep_clean(df, bench, block_bytes=block)
    assert kept.columns == df.columns
    bad = {(r[0], r[1]) for r in want if r[-1]}
    clean = [d for d in docs if not plain([d], items)[0][-1]]
    assert bad and sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(clean, key=str)


def test_given_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in bench.collect()])
    got = decontaminate.contamination(docs, bench)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a")], "item_id long, text string")
    none, no_items = docs.limit(0), bench.limit(0)
    assert decontaminate.contamination(none, bench).collect() == []
    assert decontaminate.keep_clean(none, bench).collect() == []
    assert decontaminate.contamination(docs, no_items).first()[1:4] == (3, 0, 0)
    assert decontaminate.keep_clean(docs, no_items).count() == 1
