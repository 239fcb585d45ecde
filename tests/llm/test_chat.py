"""Formatted conversations read back, against plain loops."""

import hashlib
import itertools

from conftest import SMALL

from touchline.llm import chat, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def escape(s):
    return s.replace("\\", "\\b").replace("<", "\\l")


def plain(rows):
    """rows: (conv, turn, role, text); the digests the query returns."""
    first = lambda v: (v is not None, v if v is not None else 0)
    rows = sorted(((c, t, r or "", x) for c, t, r, x in rows),
                  key=lambda r: (first(r[0]), first(r[1]), r[2], r[3] is not None, r[3] or ""))
    out = {}
    for conv, group in itertools.groupby(rows, key=lambda r: r[0]):
        turns = [(r, x or "") for _, _, r, x in group]
        loss = "".join(x for r, x in turns if r == "assistant")
        whole = "".join(
            "<turn>" + escape(r).replace("\n", "\\n") + "\n" + escape(x) + "</turn>\n"
            for r, x in turns)
        out[conv] = (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss),
                     sha(loss), len(whole))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "z", 3) for r in rows],
                               "conv_id long, turn long, role string, text string, "
                               "formatted string, n_turns int")
    got = chat.report(chat.format_chats(df)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == plain(rows)
    assert len(got) == len(plain(rows))


def test_hostile_texts(spark):
    texts = [None, "", "\\", "\\l", "\\b", "\\\\l<", "<", "</turn>\n", "<turn>user\nhi</turn>\n",
             "\n", "a\nb", "<image:1/>", "é日本\U0001f600", "$1 \\1 .*", "x" * 300_000]
    rows = [(i, 0, "user", t) for i, t in enumerate(texts)]
    rows += [(i, 1, "assistant", t) for i, t in enumerate(reversed(texts))]
    rows += [(50, j, "assistant" if j % 2 else "user", t)
             for j, t in enumerate(a + b for a in texts[1:9] for b in texts[1:9])]
    rows += [(60, None, None, "x"), (60, 1, "a\nb<\\", "y"), (None, 1, "assistant", "z"),
             (60, 1, "assistant", "t1"), (60, 1, "assistant", "t1"), (60, 1, "assistant", None)]
    check(spark, rows)


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    text = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", text), (-7, 1, "assistant", text)]
    got = queries.op10_chat(spark, SMALL)
    assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == plain(rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_segments_and_attachments(spark):
    part = lambda kind, **k: {"type": kind, **k}
    rows = [
        (1, 0, "user", [part("text", text="see <"), part("image", ref="s3://a.png", width=57, height=28),
                        part("text", text=" and "), part("audio", ref="b.wav", seconds=1.01)]),
        (1, 1, "assistant", [part("text", text="ok\\"), part("document", ref="c.pdf", pages=3)]),
        (1, 2, "user", None), (1, 3, "user", [None, part("video", ref="d"), part("image", ref=None)]),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    row = chat.format_chats(df, parts_col="parts").first()
    assert row.formatted == (
        "<turn>user\nsee \\l<image:1/> and <audio:2/></turn>\n"
        "<turn>assistant\nok\\b<document:3/></turn>\n<turn>user\n</turn>\n"
        "<turn>user\n<video:4/><image:5/></turn>\n")
    assert "".join(s.text for s in row.segments) == row.formatted
    assert [s.text for s in row.segments if s.loss] == ["ok\\b<document:3/>"]
    assert [tuple(a) for a in row.attachments] == [
        (1, 0, "image", "s3://a.png", 3), (2, 0, "audio", "b.wav", 26),
        (3, 1, "document", "c.pdf", 2400), (4, 3, "video", "d", 0), (5, 3, "image", None, 0)]


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.report(chat.format_chats(df)).collect() == []
    assert chat.probe(spark).count() == 2
