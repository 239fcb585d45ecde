"""Reading archives of many small records."""

import time

import pytest

from touchline.llm import warc


def test_many_small_records_in_linear_time():
    one = warc.page_record(7, "http://a/", b"x" * 40, None)
    data = one * (8_000_000 // len(one))
    start = time.perf_counter()
    count = sum(1 for _ in warc.members(data))
    assert count == len(data) // len(one)
    assert time.perf_counter() - start < 10


def test_members_of_all_sizes():
    bodies = [b"", b"a", b"b" * 70_000, bytes(range(256)) * 3_000, b"c"]
    records = [warc.record([("WARC-Type", "x")], b) for b in bodies]
    found = [warc.parsed(m)[1] for m in warc.members(b"".join(records))]
    assert found == bodies
    with pytest.raises(ValueError):
        list(warc.members(b"".join(records)[:-5]))
    assert list(warc.members(b"")) == []
