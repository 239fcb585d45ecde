"""Archives written, damaged, written again and read back."""

import base64
import gzip
import hashlib
from pathlib import Path

import pytest
from conftest import SMALL

from touchline.llm import queries, warc


def plain(rows):
    leader = {}
    for p, _, h in rows:
        if p is not None or (h or "") not in leader:
            old = leader.get(h or "")
            leader[h or ""] = p if old is None else max(old, p) if p is not None else old
    out = []
    for p, _, h in rows:
        data = (h or "").encode()
        first = leader[h or ""] == p
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "response" if first else "revisit", None if first else leader[h or ""]))
    return sorted(out, key=str)


def odd_rows():
    rows = [(None, "u", None), (None, None, "only null"), (1, "http://a/\r\nX: y", ""), (2, None, None),
            (3, "u", "é\r\n\r\n日本" * 50), (4, "u", "é\r\n\r\n日本" * 50), (4, "u", "é\r\n\r\n日本" * 50),
            (4, "v", "other"), (5, "u", "x" * 500_000), (10 ** 15, "far", "y"), (-10 ** 15, "far", "y")]
    return rows + [(100 + i, f"http://h/{i}", f"page {i % 90} " * (i % 70)) for i in range(400)]


def files(folder):
    return {p.name: p.read_bytes() for p in Path(folder).glob("*.warc.gz")}


@pytest.mark.parametrize("sizes", [(warc.SHARD_BYTES, warc.FILE_BYTES), (20_000, 5_000), (1, 1)])
def test_odd_rows(spark, tmp_path, sizes):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 1, "z") for r in rows],
                               "page_id long, url string, html string, shard int, payload string")
    manifest = warc.write(df, str(tmp_path / "a"), shard_bytes=sizes[0], file_bytes=sizes[1])
    records = warc.read(spark, str(tmp_path / "a"))
    assert sorted(map(tuple, warc.report(records).collect()), key=str) == plain(rows)
    texts = {(r.page_id, r.payload_digest): r.payload for r in records.collect() if r.payload is not None}
    assert bytes(texts[5, plain([(5, "", "x" * 500_000)])[0][2]]) == b"x" * 500_000
    found = files(tmp_path / "a")
    assert {(m.name, m.bytes, m.sha256) for m in manifest.collect()} == {
        (n, len(b), hashlib.sha256(b).hexdigest()) for n, b in found.items()}
    assert sum(m.records for m in manifest.collect()) == len(rows)
    assert not (tmp_path / "a" / "_held").exists()
    # The same rows in another order and other partitions: the same bytes.
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    again = df.repartition(5, "html")
    warc.write(again, str(tmp_path / "b"), shard_bytes=sizes[0], file_bytes=sizes[1])
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert files(tmp_path / "b") == found
    if sizes[1] == 5_000:
        assert len(found) > 10 and all(
            len(b) <= 5_000 or gzip.decompress(b).count(b"WARC/1.1\r\n") == 2 for b in found.values())
        ids = [[warc.page_number(h["WARC-Record-ID"]) for h, _ in map(warc.parsed, warc.members(found[n]))
                if h["WARC-Type"] != "warcinfo"] for n in sorted(found)]
        flat = [i for part in ids for i in part if i is not None]
        assert flat == sorted(flat)


def test_damage_is_noticed(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "body")], "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "a"))
    (name, data), = files(tmp_path / "a").items()
    info, page = warc.members(data)
    bad = page.replace(b"body", b"BODY")
    (tmp_path / "a" / name).write_bytes(gzip.compress(info) + gzip.compress(bad))
    with pytest.raises(Exception, match="damaged record"):
        warc.read(spark, str(tmp_path / "a")).collect()


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/pages.parquet")
            .select("page_id", "url", "html").collect()]
    got = queries.op6_warc(spark, SMALL)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write(df, str(tmp_path / "a")).count() == 0
    assert warc.read(spark, str(tmp_path / "a")).collect() == []
