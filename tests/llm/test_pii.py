"""Personal data against plain regular expressions and a graph in dictionaries."""

import hashlib
import random
import re
from collections import defaultdict

from conftest import SMALL

from touchline.llm import pii, queries

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def plain_base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(EMAIL, text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(IP, text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(CARD, text):
        d = [int(c) for c in m[0] if c.isdigit()]
        twice = [sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d))]
        if 14 <= len(d) <= 19 and sum(twice) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(PHONE, text)
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def normal(word):
    return re.sub("[0-9]", "#", word.strip(".,;:!?\"'()[]{}<>").lower())


def places(words, i, j):
    """The contexts around the words i to j (normalised)."""
    near, far = (words[k] if k >= 0 else "^" for k in (i - 1, i - 2))
    after = "$" if j + 1 >= len(words) else words[j + 1]
    out = [(1, near, i > 0), (2, near, far, i > 0, i > 1)]
    return out + [(3, near, after, i > 0, j + 1 < len(words))] * (i == j)


def plain(rows):
    docs, occurs = [], defaultdict(int)
    for d, t in rows:
        t, base = t or "", plain_base(t)
        spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        raw = [t[a:b] for a, b in spans]
        words = [normal(x) for x in raw]
        for i in range(len(words)):
            for c in places(words, i, i):
                occurs[c] += 1
        inst = [(a, b, True) for a, b in {(a, b) for a, _, b in base}]
        for (a, _), word in zip(spans, raw):
            s = word.strip(".,;:!?\"'()[]{}<>")
            a += word.find(s) if s else 0
            if (re.search("[0-9]", word) and 4 <= len(s) <= 64
                    and not any(x < a + len(s) and a < y for x, _, y in base)):
                inst.append((a, a + len(s), False))
        found = []
        for a, b, seed in inst:
            i = max(k for k, (x, _) in enumerate(spans) if x <= a)
            j = max(k for k, (x, _) in enumerate(spans) if x < b)
            kind = "".join("9" if c in "0123456789" else "a" if c.isalpha() else c for c in t[a:b])
            kind = re.sub(r"([9a])\1+", r"\1", kind)
            inside = t[spans[i][0]:a].strip(".,;:!?\"'()[]{}<>")
            found.append((a, b, seed, [] if inside else [(c, kind) for c in places(words, i, j)]))
        docs.append((d, t, base, found))
    graph, seeds = defaultdict(lambda: defaultdict(int)), set()
    for _, t, _, inst in docs:
        for a, b, seed, around in inst:
            for p in around:
                graph[p][t[a:b].lower()] += 1
            if seed:
                seeds.add(t[a:b].lower())
    graph = {p: vs for p, vs in graph.items() if len(vs) >= pii.SUPPORT
             and sum(vs.values()) * pii.ONE >= pii.ACCEPT * occurs[p[0]]}
    seeds &= {v for vs in graph.values() for v in vs}
    known = dict.fromkeys(seeds, pii.ONE)
    for _ in range(3):
        conf = {p: min(pii.ONE, sum(n * known.get(v, 0) for v, n in vs.items()) // occurs[p[0]])
                for p, vs in graph.items()
                if sum(known.get(v, 0) >= pii.ACCEPT for v in vs) >= pii.SUPPORT}
        best = defaultdict(int)
        for p, c in conf.items():
            for v in graph[p]:
                best[v] = max(best[v], c)
        known = {**best, **dict.fromkeys(seeds, pii.ONE)}
    good = {p for p, c in conf.items() if c >= pii.ACCEPT}
    out = []
    for d, t, base, inst in docs:
        more = {(a, 4, b) for a, b, s, around in inst if not s and good & set(around)}

        def joined(spans):
            return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))

        out.append((d, *(sum(k == i for _, k, _ in base) for i in range(4)),
                    hashlib.sha256(joined(base).encode()).hexdigest(),
                    joined([*base, *more])))
    return sorted(out, key=str)


def odd_rows():
    rng = random.Random(8)
    rows = [(None, None), (1, ""), (2, "é" * 100 + " a@b.c"), (2, "é" * 100 + " a@b.c"),
            (3, "x@y @z.w a@@b.c a@b.c@d.e .@-.-"), (4, "1.2.3.4.5.6.7.8 256.1.1.1 001.0002.3.4"),
            (5, "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111"),
            (6, "+1 (555) 123-4567 ++49 30 1234567890- +1 2"), (7, "9" * 5000 + "." + "1" * 5000),
            (8, "+1" + "(" * 20_000), (9, "a" * 100_000 + "@"), (10, "1." * 20_000), (11, "٣٣.1.1.1")]
    rng = random.Random(8)
    for i in range(60):  # "account no" comes before cards, and before other numbers
        good = next(c for c in range(10) if pii.luhn(f"411111111111{i:03d}{c}"))
        number = f"411111111111{i:03d}{good if i % 5 else (good + 1) % 10}"
        rows.append((100 + i, f"Please use account no {number} now."))
        rows.append((200 + i, f"é the {i:05d} of the account, and the {'9' * (i % 7)} x"))
        parts = ["a", "@", ".", "1", "23", "255", "+", " ", "-", "(", "4111", "mail", "\n", "é"]
        rows.append((300 + i, "".join(rng.choice(parts) for _ in range(60))))
    return rows


def test_odd_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, spans string")
    got = pii.report(pii.find_personal_data(df)).collect()
    want = plain(rows)
    assert sorted(map(tuple, got), key=str) == want
    for r in want:
        if r[0] and 100 <= r[0] < 160:
            assert ("context" in r[-1]) == (r[0] % 5 == 0)


def test_planted_and_decoy_values(spark):
    """Unseen identifiers in learned contexts are found, numbers elsewhere are not."""
    rng = random.Random(3)
    filler = "the of and in a to is on at customer record page order was seen".split()
    docs, planted = [], set()
    for i in range(600):
        body = [rng.choice(filler) for _ in range(40)]
        body[rng.randrange(40)] = f"{rng.randrange(10 ** 15, 10 ** 16)}"  # mostly no card
        body[rng.randrange(40)] = f"10.0.{rng.randrange(256)}.{rng.randrange(256)}"
        kind = i % 3
        if kind == 0:
            secret = f"{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}.7"
        elif kind == 1:  # no address, as one part is too large
            secret = f"{rng.randrange(300, 999)}.{rng.randrange(256)}.{rng.randrange(256)}.7"
        text = " ".join(body)
        if kind < 2 and i % 2:
            text += f" login from host {secret} today"
            if kind == 1:
                planted.add((i, text.index(secret), text.index(secret) + len(secret)))
        docs.append((i, text))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r.doc_id, s["start"], s["end"]) for r in pii.find_personal_data(df).collect()
             for s in r.spans if s["kind"] == 4}
    assert len(planted) == 100
    hit = len(found & planted)
    assert hit >= 0.9 * len(planted) and hit >= 0.9 * len(found)


def test_given_table(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op8_pii(spark, SMALL)
    assert sorted(map(tuple, got.collect()), key=str) == plain(map(tuple, rows))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_personal_data(df).collect() == []
