"""Conversation repair by brute force: every path of edits, and the DP kept as whole strings."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from oracle import difference
from pyspark.sql import functions as F

from tidewheel.llm import chat_repair as R
from tidewheel.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_damage(rows):
    out = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        out += [] if kind == 0 else [row] * (2 if kind == 3 else 1)
    return out


def signs(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        late = bare[-1:] not in (".", "!", "?")
        i = role[:1] if role[:1] in ("s", "u", "a") else "o"
        out.append("b" if not bare else "d" if (role, text) in seen else i.upper() if late else i)
        seen.add((role, text))
    return out


def plain_repair(codes):
    """(cost, audit) of the least repair: states keep their least whole audit."""
    best = {"": (0, "")}

    def better(d, k, v):
        if k not in d or v < d[k]:
            d[k] = v

    def insert(d):
        for _ in range(3):
            for k, (c, a) in list(d.items()):
                better(d, "a" if k == "u" else "u", (c + 5, a + "I"))

    for code in codes:
        insert(best)
        new = {}
        for k, (c, a) in best.items():
            better(new, k, (c + 2, a + "D"))
            if code in "bd":
                continue
            late, role, role_next = 5 * code.isupper(), code.lower(), "a" if k == "u" else "u"
            better(new, role_next, (c + late + 1, a + "R"))
            if role == "s" and k == "" or role == role_next:
                better(new, role, (c + late, a + "K"))
        best = new
    insert(best)
    return min(v for k, v in best.items() if k in ("", "a"))


def put_out(rows, audit):
    left, lines = iter(rows), []
    role = lambda: "assistant" if lines and lines[-1][0][0] == "u" else "user"
    for edit in audit:
        if edit == "I":
            lines.append((role(), ""))
            continue
        r = next(left)
        if edit != "D":
            lines.append((r[2] if edit == "K" else role(), r[3]))
    assert next(left, None) is None and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in lines))
    return sha("\n".join(f"{r}:{t}" for r, t in lines))


def brute(rows, every):
    by = {c: [] for c in every}
    for r in rows:
        by[r[0]].append(r)
    out = {}
    for c, mine in by.items():
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        codes, turns = signs(mine), {r[1] for r in mine if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit = plain_repair(codes)
        out[c] = (gaps, codes.count("b"), codes.count("d"), sum(x.isupper() for x in codes), illegal, cost, audit, put_out(mine, audit))
    return out


def found(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


def every_path(codes):
    """(cost, audit) of the least of all paths, with up to two inserts at a place."""
    best = (99, "")
    places = [[i + e for i in ("", "I", "II") for e in ("DRK" if c not in "bd" else "D")] for c in codes] + [["", "I", "II"]]
    for path in itertools.product(*places):
        audit, roles, cost = "".join(path), "", 0
        rows = iter(codes)
        for edit in audit:
            code = "" if edit == "I" else next(rows)
            cost += {"I": 5, "D": 2, "K": 0, "R": 1}[edit] + 5 * (edit in "KR" and code.isupper())
            roles += "" if edit == "D" else code.lower() if edit == "K" else "a" if roles[-1:] == "u" else "u"
        if re.fullmatch("(s?(ua)+)?", roles):
            best = min(best, (cost, audit))
    return best


def test_the_plain_repair_is_the_least_of_all_paths():
    for n in range(4):
        for codes in itertools.product("bsuaoSA" if n == 3 else R.ROWS, repeat=n):
            assert plain_repair(codes) == every_path(codes)


def test_ranks_by_plain_repair():
    rng = random.Random(1)
    rows = ["".join(rng.choice(R.ROWS if i % 2 else "uuaao") for _ in range(rng.choice([1, 2, 3, 8, 60]))) for i in range(600)]
    audits, exits, costs = R.ranked(rows, np.tile(R.END, (len(rows), 1)), [[0]] * len(rows))
    assert [(c[0], a[0] + R._TAIL[e[0]]) for c, a, e in zip(costs.tolist(), audits, exits, strict=True)] == [plain_repair(r) for r in rows]


def chats(rng, n, length):
    texts = ["Yes.", "no", "Why?", "", " \n ", None, "Stop!", "ok\t\n", "é.", "x. "] + [f"text {i}{'.' if i % 5 else ''}" for i in range(300)]
    roles = ["user", "assistant"] * 8 + ["system", "tool", None, "", "User", "s", "a"]
    return [(c, rng.choice([None, t, t, t, t, t + rng.randint(0, 5)]), roles[t % 2] if rng.random() < 0.7 else rng.choice(roles), rng.choice(texts)) for c in range(n) for t in range(rng.randint(1, length))]


def test_damaged_conversations(spark):
    rng = random.Random(2)
    rows = chats(rng, 150, 12) + [(None, t, "user" if t % 2 else "assistant", f"null {t}.") for t in range(9)] + [(7, 3, "user", "Yes.")] * 3
    df = spark.createDataFrame(rows, SCHEMA).withColumn("idx", F.lit("clash")).withColumn("grp", F.lit(1)).withColumn("a`b", F.lit(0))
    assert {tuple(r) for r in R.damaged(df).collect()} == set(plain_damage(rows)) and R.damaged(df).count() == len(plain_damage(rows))
    assert found(R.repair(R.damaged(df.repartition(6)), df)) == brute(plain_damage(rows), {r[0] for r in rows})
    assert R.repair(df.limit(0)).count() == 0
    alone = spark.createDataFrame([(20, t, "user", "x.") for t in range(200) if zlib.crc32(f"20:{t}".encode()) % 20 == 0], SCHEMA)
    assert found(R.repair(R.damaged(alone), alone)) == {20: (0, 0, 0, 0, 0, 0, "", sha(""))}


def test_conversations_of_many_segments(spark):
    """Two of several segments among short ones, with roles such that what is put out at a segment's end varies."""
    rng = random.Random(3)
    rows = chats(rng, 20, 6)
    for c, n in ((100, R.SEGMENT), (101, 2 * R.SEGMENT + 7), (102, 3 * R.SEGMENT)):
        rows += [(c, t, rng.choice(["user", "assistant", "assistant", "system", "tool"]), f"line {t}{rng.choice(['.', '.', '!', ''])}") for t in range(n)]
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    df = spark.createDataFrame(rows, SCHEMA).repartition(9)
    assert found(R.repair(df)) == brute(rows, {r[0] for r in rows})


def test_many_equal_rows_of_one_conversation(spark):
    df = spark.range(30_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("same.").alias("text"))
    got = R.repair(df).first()
    assert (got.duplicate, got.cost, got.illegal, got.gaps) == (29_998, 59_996, 0, 0)
    assert got.audit == "KK" + "D" * 29_998 and got.repaired_sha256 == sha("user:same.\nassistant:same.")


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_gives_the_rows_of_its_sql(spark, sf):
    assert not difference(QUERIES["op13_chat_repair"](spark, f"/root/testdata/sf{sf}"), ORACLES["op13_chat_repair"], f"/root/testdata/sf{sf}")
