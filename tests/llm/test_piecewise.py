"""Piecewise hashing: chunks by their definition, edit distance by plain code, spliced neighbours by brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import piecewise as P


def plain_chunks(data, size):
    """Chunks of data where the hash of the last WINDOW bytes is divisible by size, a byte at a time."""
    out, start = [], 0
    for i in range(len(data)):
        seen = data[max(0, i - P.WINDOW + 1) : i + 1].rjust(P.WINDOW, b"\0")
        if int(P._rolled(np.frombuffer(seen, "u1"))[0]) % size == 0:
            out.append(data[start : i + 1])
            start = i + 1
    return out + ([data[start:]] if start < len(data) else [])


def plain_signature(chunks):
    signs = ""
    for c in chunks:
        h = sum((b + 1) * pow(P._STEP, i, 1 << 64) for i, b in enumerate(c)) % (1 << 64)
        h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 % (1 << 64)
        h ^= h >> 29
        signs += "".join(P.SIGNS[h >> 58 - 6 * j & 63] for j in range(1 if len(chunks) >= P.RUN else P.RUN))
    return signs


def plain_fingerprint(text):
    data, size = text.encode(), P.LEAST
    while len(data) * 4 > 3 * size * P.MOST or len(plain_chunks(data, size)) > P.MOST:
        size *= 2
    return f"{size}:{plain_signature(plain_chunks(data, size))}:{plain_signature(plain_chunks(data, 2 * size))}"


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(row[j] if x == y else min(row[j + 1], new[j]) + 1)
        row = new
    return row[-1]


def plain_likeness(x, y):
    if x == y:
        return 1.0
    (s, *a), (t, *b) = x.split(":"), y.split(":")
    pairs = {1: zip(a, b), 2: [(a[0], b[1])], 0.5: [(a[1], b[0])]}.get(int(s) / int(t), [])
    best = 0.0
    for p, q in pairs:
        if any(p[i : i + P.RUN] in q for i in range(len(p) - P.RUN + 1)):
            best = max(best, 1 - plain_distance(p, q) / (len(p) + len(q)))
    return best


def some_texts(n=60):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgé🙂") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    return ["", "x", "\0" * 40, "ab" * 300, "a" * 5000, *(" ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 40, 400]))) for _ in range(n))]


def test_fingerprints_by_their_definition(monkeypatch):
    texts = some_texts(30)
    want = [plain_fingerprint(t) if t else "3::" for t in texts]
    assert [P.fingerprint(t) for t in texts] == want and P.fingerprint(None) == "3::"
    monkeypatch.setattr(P, "BLOCK", 50)  # a text of many blocks
    assert [P.fingerprint(t) for t in texts] == want


def test_no_length_makes_a_signature_longer():
    text = "".join(random.Random(5).choices("etaoin shrdlu\n", k=3_000_000))
    size, one, two = P.fingerprint(text).split(":")
    assert int(size) >= 3_000_000 / 64 and 20 < len(one) <= P.MOST and 8 < len(two) < len(one)


def test_likeness_by_plain_edit_distance():
    texts = some_texts()
    prints = [P.fingerprint(t) for t in texts] + ["3:ABCD:ABCD", "6:ABCD:XYZW", "3:AAAA:", "12:ABCD:"]
    rng = random.Random(6)
    left = [rng.choice(prints) for _ in range(1500)] + [P.fingerprint(t) for t in texts] * 2
    right = [rng.choice(prints) for _ in range(1500)] + [P.fingerprint(t[: len(t) // 3] + "!" + t[len(t) // 3 :]) for t in texts] + [P.fingerprint(t) for t in texts]
    got = P.likeness(left, right)
    assert got == pytest.approx([plain_likeness(a, b) for a, b in zip(left, right, strict=True)], abs=1e-12)
    assert (got[-len(texts) :] == 1).all() and ((0 <= got) & (got <= 1)).all()
    long = [i for i, t in enumerate(texts) if len(t) > 200 and len(set(t)) > 2]
    assert min(got[1500 + i] for i in long) > 0.8  # one sign put in


def brute_splice(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        t, after = t or "", after or ""
        e = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        f, g, h = map(P.fingerprint, (t, e, after))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, plain_likeness(f, g), plain_likeness(f, h)))
    return out


def close(got, want):
    key = lambda r: tuple((x is None, x) for x in r)
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [x for r in got for x in r[5:]] == pytest.approx([x for r in want for x in r[5:]], abs=1e-12)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_neighbours_over_partitions(spark, docs, parts, monkeypatch):
    """Partitions of many rows, of one row and without rows."""
    rows = [(r.doc_id, r.text) for r in docs.limit(60).collect()] + [(900_000, None), (None, "no id " * 20), (900_001, ""), (900_002, "Ünï 🙂 " * 30)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for key, value in (("spark.sql.shuffle.partitions", parts), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        spark.conf.set(key, value)
    try:
        df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, part int, id string")
        close(P.splice_and_compare(df).collect(), brute_splice(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_edge_cases(spark, odd):
    got = P.splice_and_compare(odd).collect()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    close(got, brute_splice(rows))
    assert P.splice_and_compare(odd.limit(0)).count() == 0
    one = P.splice_and_compare(spark.createDataFrame([("k", "abc def")], "doc_id string, text string")).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [("k", 1.0)] and one[0].edited_sha256 == hashlib.sha256(b"abc abc").hexdigest()


def test_columns(spark, odd):
    marked = P.with_fingerprint(odd).select("text", "fingerprint").collect()
    assert all(r.fingerprint == P.fingerprint(r.text) for r in marked)
    pair = spark.createDataFrame([("3:ABCDEFGH:ABCD", "3:ABCDXFGH:ABCD")], "a string, b string")
    assert pair.select(P.alike(F.col("a"), F.col("b"))).first()[0] == 1.0


def test_copies_are_alike_and_strangers_are_not(docs):
    texts = [r.text or "" for r in docs.select("text").collect()]
    prints = [P.fingerprint(t) for t in texts]
    edited = [P.fingerprint(P.spliced(a, b)) for a, b in zip(texts, texts[1:] + texts[:1], strict=True)]
    near, other = P.likeness(prints, edited), P.likeness(prints, prints[1:] + prints[:1])
    assert np.mean(near > other) >= 0.95 and np.median(near) > 0.5 and np.mean(other > 0.3) < 0.02
