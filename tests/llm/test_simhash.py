"""SimHash classes against a plain comparison of all pairs."""

import random

import pytest
import xxhash
from conftest import SMALL

from touchline.llm import simhash


def plain_fingerprint(text):
    words = [w for w in "".join(
        chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c
        for c in text or "").split(" ") if w]
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(prints):
    """prints: list of (doc_id, fingerprint); rows with the class's least id."""
    values = sorted({f for _, f in prints})
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    least = {}
    for d, f in prints:
        if d is not None:
            least[root(f)] = min(d, least.get(root(f), d))
    return sorted(((d, f"{f:016x}", least.get(root(f))) for d, f in prints), key=str)


def documents(spark, rows, extra=False):
    schema = "doc_id long, text string" + (", fp string, root int, text_key string" if extra else "")
    return spark.createDataFrame([(*r, "x", 1, "y") if extra else r for r in rows], schema)


def found(df):
    assert df.columns == ["doc_id", "fingerprint", "component_id"]
    return sorted(map(tuple, df.collect()), key=str)


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet")
            .select("doc_id", "text").collect()]
    want = plain_classes([(d, plain_fingerprint(t)) for d, t in rows])
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert found(simhash.near_duplicates(docs)) == want


@pytest.mark.parametrize("crowded", [20_000, 3])
def test_odd_rows(spark, crowded):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    base = [rng.choice(words) for _ in range(400)]
    rows = [(None, None), (7, None), (8, ""), (9, " \t\n"), (10, "One"), (11, "one"), (12, "one"),
            (12, "one"), (None, "one two three"), (13, "É b c d e f"), (14, "é b c d e f")]
    for i in range(60):  # near copies, whose links chain
        copy = list(base)
        for _ in range(i // 12):
            copy[rng.randrange(400)] = rng.choice(words)
        rows.append((100 + i, " ".join(copy)))
    rows.append((300, " ".join(rng.choice(words) for _ in range(200_000))))
    want = plain_classes([(d, plain_fingerprint(t)) for d, t in rows])
    assert len({r[2] for r in want}) > 4
    assert found(simhash.near_duplicates(documents(spark, rows, True), crowded=crowded)) == want
    kept = simhash.keep_one(documents(spark, rows, True)).collect()
    prints = {}
    for d, t in rows:
        prints.setdefault((d, t), plain_fingerprint(t))
    ids = sorted(str(r.doc_id) for r in kept)
    assert ids == sorted({str(r[2]) for r in want})
    assert set(kept[0].asDict()) == {"doc_id", "text", "fp", "root", "text_key"}


@pytest.mark.parametrize("crowded", [20_000, 40, 2])
def test_links_of_random_balls(spark, crowded):
    """Planted fingerprints at all distances, hot buckets dealt again."""
    rng = random.Random(11)
    values = {rng.getrandbits(64) for _ in range(150)}
    for v in rng.sample(sorted(values), 40):
        for _ in range(8):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 8))))
    df = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    roots = simhash.components(simhash.links(df, crowded)).collect()
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in roots}
    groups, want = {}, {}
    for v in values:
        groups.setdefault(got.get(v, v), set()).add(v)
    for i, (d, _, c) in enumerate(plain_classes([(v, v) for v in sorted(values)])):
        want.setdefault(c, set()).add(d)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_buckets_follow_the_table():
    assert simhash.first_bits(0, 2000) == simhash.first_bits(400_000, 2000) == 16
    assert [simhash.first_bits(10 ** n, 2000) for n in (6, 7, 9, 12)] == [24, 24, 32, 40]


def test_empty(spark):
    assert found(simhash.near_duplicates(documents(spark, []))) == []
    assert simhash.keep_one(documents(spark, [])).collect() == []
