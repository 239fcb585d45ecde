"""Short notices against a plain search by edit distance."""

import random
import re

import compare
from conftest import SMALL

from touchline.llm import licenses, oracle, queries
from touchline.llm.licenses import BASE, NOTICES, Notice

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def distance(a, b, limit):
    """Edits between two byte strings; more than ``limit`` is None."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        if min(row) > limit:
            return None
    return row[-1] if row[-1] <= limit else None


def plain_places(found, notices):
    """(notice, first, end, edits): the best of those that overlap."""
    out = []
    for k, n in enumerate(notices):
        want, tried = n.text.encode(), []
        fixed = n.text.split()[:n.fixed]
        for i in range(len(found)):
            if found[i:i + n.fixed] != fixed:
                continue
            for j in range(i + 1, len(found) + 1):
                run = " ".join(found[i:j]).encode()
                if len(run) > len(want) + n.errors:
                    break
                e = distance(run, want, n.errors)
                if e is not None:
                    tried.append((e, i, j))
        free = set(range(len(found)))
        for e, i, j in sorted(tried):
            if free.issuperset(range(i, j)):
                free.difference_update(range(i, j))
                out.append((k, i, j, e))
    return sorted(out)


def plain(doc_id, text, notices=NOTICES):
    found = words(text)
    exact = [(i, label) for phrase, label in ((p.split(), la) for la, p in BASE)
             for i in range(len(found)) if found[i:i + len(phrase)] == phrase]
    places = plain_places(found, notices)
    base = {label for _, label in exact}
    score = max([1.0 - e / len(notices[k].text) for k, _, _, e in places], default=0.0)
    at = [i for i, _ in exact]
    return (doc_id, len(found), len(exact), min(at, default=None), max(at, default=None),
            ",".join(sorted(base)), ",".join(sorted(base | {notices[k].label for k, *_ in places})),
            1.0 if exact else score), places


def edited(rng, text, times):
    text = list(text)
    for _ in range(times):
        at = rng.randrange(len(text))
        kind = rng.randrange(3)
        if kind == 0:
            text[at] = rng.choice("abcxyz é-")
        elif kind == 1:
            text.insert(at, rng.choice("abcxyz é-"))
        else:
            del text[at]
    return "".join(text)


def random_docs():
    rng = random.Random(7)
    filler = ["the", "license", "permission", "is", "été", "mit", "public", "x1", "general", "under"]
    docs = [(None, None), (1, ""), (2, " .. "), (3, "MIT-License"), (4, "emit license; mit licence"),
            (5, "mit license mit license, Mit\nLicense"), (None, "apache  LICENSE")]
    for d in range(60):
        body = [rng.choice(filler) for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            notice = rng.choice(NOTICES)
            body.insert(rng.randrange(len(body) + 1),
                        edited(rng, notice.text, rng.randrange(notice.errors + 2)))
        docs.append((100 + d, rng.choice([" ", "  ", ", ", "\n* "]).join(body)))
    return docs + [docs[-1]]


def frame(spark, docs):
    return spark.createDataFrame([(*d, 1, ["x"]) for d in docs],
                                 "doc_id long, text string, labels int, places array<string>")


def test_random_tables(spark):
    docs = random_docs()
    rows = licenses.find_notices(frame(spark, docs)).collect()
    want = [plain(*d) for d in docs]
    assert sorted((tuple(r[:8]) for r in rows), key=str) == sorted((x for x, _ in want), key=str)
    by_id = {x[0]: (places, text) for (x, places), (_, text) in zip(want, docs)}
    for row in rows:
        if row.doc_id is not None:
            places, text = by_id[row.doc_id]
            got = sorted((p["notice"], p["first_word"], p["end_word"], p["edits"]) for p in row.places)
            assert got == places
            for p in row.places:
                assert words(text[p["start"]:p["end"]]) == words(text)[p["first_word"]:p["end_word"]]
    assert {r.labels for r in rows} >= {"", "mit", "cc"} and any(0 < r.score < 1 for r in rows)


def test_no_edit_in_a_fixed_word(spark):
    docs = [(1, "emit license"), (2, "mit licence"), (3, "mitlicense")]
    rows = licenses.report(licenses.find_notices(frame(spark, docs))).collect()
    assert {r.doc_id: r.labels for r in rows} == {1: "", 2: "mit", 3: ""}


def test_overlapping_base_places_all_count(spark):
    docs = [(1, "a a a a"), (2, "b a")]
    found = licenses.find_notices(frame(spark, docs), notices=(Notice("x", "b a", 0),), base=(("aa", "a a"),))
    rows = {r.doc_id: r for r in found.collect()}
    assert (rows[1].n_base, rows[1].first_word, rows[1].last_word) == (3, 0, 2)
    assert (rows[2].labels, rows[2].n_base, rows[2].score) == ("x", 0, 1.0)


def test_long_texts(spark):
    """A megabyte of one word, and of beginnings of a notice."""
    start = "permission is hereby granted "
    docs = [(1, "license " * 130_000 + "mit license"), (2, start * 30_000), (3, "x" * 1_000_000)]
    rows = {r.doc_id: r for r in licenses.find_notices(frame(spark, docs)).collect()}
    assert (rows[1].n_base, rows[1].first_word, rows[1].labels) == (1, 130_000, "mit")
    assert rows[2].labels == "" and rows[3].n_words == 1


def test_given_table(spark):
    """Against the statement, which measures edit distances with DuckDB."""
    found = compare.check(spark, compare.connect(SMALL), queries.op11_licenses,
                          oracle.LICENSES, SMALL)
    assert found == ""
    assert queries.op11_licenses(spark, SMALL).filter("labels <> ''").count() >= 3


def test_empty(spark):
    assert licenses.find_notices(frame(spark, [(1, "a")]).limit(0)).collect() == []
