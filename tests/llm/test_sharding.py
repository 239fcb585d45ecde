"""The lookup table against a slot-by-slot fill, and what the method promises."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL

from touchline.llm import queries, sharding


def plain_table(names, size):
    def h(name, salt):
        return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:16], 16)

    prefer = {n: [(h(n, "offset") % size + j * (h(n, "skip") % (size - 1) + 1)) % size
                  for j in range(size)] for n in names}
    table = {}
    while len(table) < size:
        for n in sorted(names):
            if len(table) < size:
                table[next(s for s in prefer[n] if s not in table)] = n
    return table


def plain_place(key, table, size):
    text = "null" if key is None else str(key)
    slot = int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % size
    return slot, table[slot]


def test_table():
    names = [f"n{i}" for i in range(7)]
    want = plain_table(names, 211)
    assert [names[i] for i in sharding.lookup_table(names, 211)] == [want[s] for s in range(211)]
    shares = Counter(want.values()).values()
    assert max(shares) - min(shares) <= 1
    weighted = Counter(sharding.lookup_table({"a": 1, "b": 3}, 1009).tolist())
    assert abs(weighted[1] - 3 * weighted[0]) <= 4


def test_little_moves():
    names = [f"n{i}" for i in range(20)]
    before, after = sharding.lookup_table(names, 10_007), sharding.lookup_table(sorted(names)[:-1], 10_007)
    stayed = before != 19
    assert (before[stayed] != after[stayed]).mean() < 0.05


@pytest.mark.parametrize("shards,size", [(["a"], 100), ([], 101), ({"a": 0}, 101),
                                         ([str(i) for i in range(102)], 101)])
def test_refused(shards, size):
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, size)


def test_odd_rows(spark, tmp_path):
    rows = [(None, "x", 1), (1, None, 2), (1, "y" * 100_000, 2), (1, None, 2), (-5, "", None)]
    rows += [(i, "t", i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, slot string, shard int")
    out, slot, shard = sharding.place(df, "doc_id", ["a", "b", "c"], 101)
    table = plain_table(["a", "b", "c"], 101)
    assert (slot, shard) == ("slot_", "shard_") and out.count() == len(rows)
    for r in out.collect():
        assert (r.slot_, r.shard_) == plain_place(r.doc_id, table, 101)
    assert sharding.place(df.limit(0), "doc_id", ["a"], 101)[0].count() == 0
    sharding.write_shards(df, "doc_id", ["a", "b", "c"], str(tmp_path / "out"), 101)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and back.filter("shard_ = 'a'").count() > 50


def test_given_table(spark):
    names = queries.SHARDS
    table = sharding.lookup_table(names)
    got = queries.op2_sharding(spark, SMALL).collect()
    for r in got:
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % sharding.TABLE
        assert (r.slot, r.shard) == (slot, sorted(names)[table[slot]])
    assert len(got) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert np.ptp(list(Counter(table.tolist()).values())) <= 1
