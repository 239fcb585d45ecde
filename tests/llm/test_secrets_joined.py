"""Secrets joined to other characters, against a plain loop over windows."""

import random
import re

from test_secrets import entropy, plain

from touchline.llm import secrets

RNG = random.Random(7)


def drawn(letters, n):
    return "".join(RNG.choice(letters) for _ in range(n))


def hot_windows(c):
    tokens = [m.span() for m in re.finditer("[A-Za-z0-9]+", c) if not m[0].isdigit()
              and re.fullmatch("[0-9a-f]+|[0-9A-F]+", m[0])]
    for i in range(len(c) - 19):
        kind = "hex" if any(a <= i and i + 20 <= b for a, b in tokens) else "base64"
        if entropy(c[i:i + 20]) >= secrets.THRESHOLDS[kind] - 1e-9:
            yield i


def stretch(text, c):
    hot = list(hot_windows(c))
    return [(text.index(c) + hot[0], text.index(c) + hot[-1] + 20)] if hot else []


def found(spark, texts):
    """Entropy spans of each text."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r.spans for r in secrets.find_secrets(df).collect()}
    return [[(s["start"], s["end"]) for s in rows[i] if s["kind"] == 3] for i in range(len(texts))]


def test_prefixed_hex(spark):
    joined = []
    for _ in range(20):
        joined += [("sess_", drawn("0123456789abcdef", 24)), ("KEY=", drawn("0123456789ABCDEF", 40)),
                   ("id/v1-", drawn("0123456789ABCDEF", 32))]
    joined = [(a, k) for a, k in joined if entropy(k[:20]) >= 2.9 and entropy(k[-20:]) >= 2.9]
    texts = [f"see {a}{k} here" for a, k in joined]
    got = found(spark, texts)
    for text, (a, k), spans in zip(texts, joined, got):
        at = text.index(k)
        assert len(spans) == 1 and spans[0][0] <= at and spans[0][1] >= at + len(k)
        assert spans == stretch(text, a + k)
    assert len(texts) > 50
    # Digits alone are no hex, and a whole hex candidate is as before.
    rest = ["id=73519284061735192840", "x " + drawn("0123456789ABCDEF", 40), drawn("0123456789abcdef", 24)]
    assert found(spark, rest)[0] == []
    for t, spans in zip(rest, found(spark, rest)):
        assert [f"entropy:{a}:{b}" for a, b in spans] == [
            s for s in plain(t)[-1].split(",") if s.startswith("entropy")]


def test_joined_to_patterns_and_samples(spark):
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key, access = "".join(RNG.sample(b64, 40)), "AKIA" + drawn("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)
    low = drawn("0123456789abcdef", 32)
    alphabet = b64 + "+/"
    texts = [f"é {access}/{key} x", f"{key}/{low}", f"v1/example/{key} x", f"EXAMPLE={key}",
             f"{key}-{access}-{key}", f"{access}/words-joined-to-others-by-lines", alphabet,
             f"abcdefghij/{key}", "/".join(["an/example"] * 5), alphabet[::-1][:2] + alphabet]
    got = found(spark, texts)
    assert got[5] == got[6] == got[8] == got[9] == []
    for i in (0, 1, 2, 3, 4, 7):
        at = texts[i].index(key)
        assert any(a <= at and b >= at + 40 for a, b in got[i])
    last = texts[4].rindex(key)
    assert len(got[4]) == 2 and got[4][1][0] <= last and got[4][1][1] == last + 40
    clean = secrets.redacted(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert not any(key[5:25] in r.text or access in r.text for r in clean.collect())
