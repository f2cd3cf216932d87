"""The Merkle manifest by a plain tree, at several superblock sizes."""

import hashlib
import random
import zlib

import pytest
from oracle import difference
from pyspark.sql import functions as F

from tidewheel.llm import merkle
from tidewheel.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(r, text):
    told = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)]
    return sha("".join(told))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, i):
    out = []
    for nodes in levels[:-1]:
        a = i - i % 3
        out.append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + 3])))
        i //= 3
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, plain_leaf(r, r[1]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    over = tree([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            steps = way(trees[g], i) + way(over, at)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            h = plain_leaf(r, r[1].replace("\n", "") if tampered else r[1])
            for a, b in steps:
                h = sha(a + h + b)
            out.append((r[0], leaf, trees[g][-1][0], over[-1][0], sha("".join(a + b for a, b in steps)), h, h == over[-1][0]))
    return out


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def tampered(df, **more):
    text = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"))).otherwise(F.col("text"))
    return merkle.manifest(df, changed={"text": text}, **more)


@pytest.mark.parametrize("height", [1, 2, 6])
def test_by_plain_trees(spark, height):
    """Groups of 0 to 200 rows, cut into superblocks of 3, 9 and 729, so that there are up to five tiers."""
    rng = random.Random(height)
    sizes = {None: 4, "": 1, "hot": 200, "é": 9, "z🙂": 10, "a|b,c": 28, **{f"s{i}": 1 + i % 3 for i in range(30)}}
    rows = [(rng.randrange(10**12), rng.choice(["a\nb\nc", "", None, "x", "\n" * 5]), rng.choice(["en", None]), g, rng.choice([0, None, 5])) for g, n in sizes.items() for _ in range(n)]
    rows += [(None, "no\nid", "en", "hot", 5), (None, "no id 2", "en", "hot", 5), (7, "same", "en", "hot", 4), (7, "same", "en", "hot", 4), (7, "other", None, "hot", 4)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("grp", F.lit("clash")).withColumn("h", F.lit(1)).withColumn("a`b", F.lit(2))
    assert found(tampered(df.repartition(5), height=height)) == sorted(brute(rows), key=str)


def test_edge_cases(spark, odd):
    rows = [tuple(r)[:5] for r in odd.collect()]
    assert found(tampered(odd)) == sorted(brute(rows), key=str)
    assert merkle.manifest(odd.limit(0)).count() == 0
    one = [(5, "a", None, None, 1)]
    got = found(tampered(spark.createDataFrame(one, SCHEMA)))
    assert got == brute(one) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == sha("")


def test_proofs_lead_to_the_root(spark, docs):
    kept = merkle.manifest(docs, keep_proof=True)
    again = kept.withColumn("again", merkle.fold(F.col("leaf"), F.col("proof"))).cache()
    assert again.where("again <> root or not verified or again is null").count() == 0 and again.count() == docs.count()
    joined = F.aggregate("proof", F.lit(""), lambda a, s: F.concat(a, s["left"], s["right"]))
    assert again.where(F.sha2(joined, 256) != F.col("proof_sha256")).count() == 0


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_gives_the_rows_of_its_sql(spark, sf):
    assert not difference(QUERIES["op12_merkle_manifest"](spark, f"/root/testdata/sf{sf}"), ORACLES["op12_merkle_manifest"], f"/root/testdata/sf{sf}")
