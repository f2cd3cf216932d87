"""A Merkle manifest of a data set: a tree over the rows of each group, a tree over the groups, and a proof for each row.

A row's leaf is the hash of its fields. In a tree every ARITY neighbours become
the hash of their digests, written in hex, until one node is left; the last run
of a level may be shorter, and one node alone is hashed too. The nodes left of
the groups, in the order of their names, are the leaves of the last tree, whose
one node is the root of all.

Trees are cut into superblocks of ARITY**HEIGHT neighbours, HEIGHT levels high. Upward,
a superblock becomes one node; the nodes of superblocks are cut into
superblocks again, and so on, each tier so many times smaller than the one below.
Downward, a superblock's nodes and the outer nodes that its proofs need (the
siblings on the way from its top to the root, one row) are cogrouped: one task
finishes the levels inside, joins the proofs, and folds each row's own digest
up to the root. A group of any size is so many superblocks, none of which is
larger than 729 rows of some hundred bytes; texts are hashed where they are
read and never shuffled.

Edge cases. A null field counts as "-", a null group is a group, the first, a
null id an id, the first of its group. Equal ids of a group are ordered by their
leaves; rows equal in all fields are leaves each. Empty texts are fields of no
bytes. A group of one row has its leaf as subroot, one group alone its subroot
as root. An empty table gives an empty table. Further columns are no part of
the leaf unless they are named in fields, and are left out.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, settle
from .ordering import numbered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY, HEIGHT = 3, 6

_TOP = "grp string, idx bigint, n bigint, h string"
_WAY = "grp string, idx bigint, way string, subroot string"
#: Takes the signs between the siblings of a way out.
_JOINED = str.maketrans("", "", "|,")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """Hash of fields, each "-" if null, else its bytes' count, ":" and itself."""
    told = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in told)), 256)


def fold(h: Column, proof: Column) -> Column:
    """The root that a digest and its proof (array of left and right siblings, level by level) lead to."""
    return F.aggregate(proof, h, lambda a, s: F.sha2(F.concat(s["left"], a, s["right"]), 256))


def _levels(nodes: list[str], n: int, height: int) -> list[list[str]]:
    """The levels of a superblock, of a tree of n nodes at this tier, up to its one top."""
    levels = [nodes]
    while len(levels) <= height if n > ARITY**height else len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i : i + ARITY])) for i in range(0, len(last), ARITY)])
    return levels


def _steps(levels: list[list[str]], outer: str) -> list[str]:
    """The way of each node of the lowest level to the root: "left|right," of each level, then the outer way."""
    ways = [outer]
    for nodes in reversed(levels[:-1]):
        lower = []
        for i in range(len(nodes)):
            a = i - i % ARITY
            lower.append(f"{''.join(nodes[a:i])}|{''.join(nodes[i + 1 : a + ARITY])},{ways[i // ARITY]}")
        ways = lower
    return ways


def _folded(h: str, way: str) -> str:
    for step in way.split(",")[:-1]:
        left, right = step.split("|")
        h = digest(left + h + right)
    return h


def _top(block: pd.DataFrame, height: int) -> pd.DataFrame:
    block, size = block.sort_values("idx"), ARITY**height
    n = int(block["n"].iloc[0])
    top = _levels(block["h"].tolist(), n, height)[-1][0]
    return pd.DataFrame({"grp": [block["grp"].iloc[0]], "idx": [block["idx"].iloc[0] // size], "n": [-(-n // size)], "h": [top]})


def _blocked(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"idx div {ARITY**height}"))


def _tiers(nodes: DataFrame, height: int) -> list[DataFrame]:
    """nodes (grp, idx, n, h), their superblocks' tops, the tops of these, and so on until each group has one node."""
    tiers = [nodes]
    while len(tiers) == 1 or (tiers[-1].agg(F.max("n")).first()[0] or 1) > 1:
        blocks = _blocked(tiers[-1].select("grp", "idx", "n", "h"), height).groupBy("grp", "block")
        tiers.append(settle(blocks.applyInPandas(lambda b: _top(b, height), _TOP)))
    return tiers


def _ways(nodes: pd.DataFrame, outer: pd.DataFrame, height: int) -> list[str]:
    """The ways of a superblock's nodes, from its own levels and the way of its top."""
    return _steps(_levels(nodes["h"].tolist(), int(nodes["n"].iloc[0]), height), outer["way"].iloc[0])


def _exchange(tiers: list[DataFrame], ways: DataFrame, height: int):
    """The lowest tier's superblocks, cogrouped with their tops' ways; ways (grp, idx, way, subroot) are those of the highest tier's nodes."""

    def passed_down(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("idx")
        return pd.DataFrame({"grp": nodes["grp"], "idx": nodes["idx"], "way": _ways(nodes, outer, height), "subroot": outer["subroot"].iloc[0]})

    def meet(nodes: DataFrame):
        outer = ways.select("grp", F.col("idx").alias("block"), "way", "subroot")
        return _blocked(nodes, height).groupBy("grp", "block").cogroup(outer.groupBy("grp", "block"))

    for tier in reversed(tiers[1:-1]):
        ways = meet(tier.select("grp", "idx", "n", "h")).applyInPandas(passed_down, _WAY)
    return meet(tiers[0])


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", changed: dict[str, Column] | None = None, keep_proof: bool = False, height: int = HEIGHT) -> DataFrame:
    """id_col, leaf, subroot, root, proof_sha256, folded_root, verified; with keep_proof also proof (array of left and right siblings).

    fields are hashed in their order. changed: columns that stand for fields in
    a second copy of the data; where they differ, the copy's leaf is what is
    folded with the siblings of the first, and verified tells whether that
    leads to the root. id_col is of a type that strings can be cast to.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    changed = changed or {}
    name = lambda c: F.col(*quoted([c]))
    group = name(group_col).cast("string")
    rows = docs.select(
        F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group)).alias("grp"),  # the null group first, others by their bytes
        name(id_col).alias("id"),
        leaf([name(c) for c in fields]).alias("h"),
        leaf([changed.get(c, name(c)) for c in fields]).alias("now"),
    )
    rows = settle(rows.withColumn("now", F.when(F.col("now") != F.col("h"), F.col("now"))))
    leaves = numbered(rows, "grp", [F.col("id").asc_nulls_first(), F.col("h")])
    leaves = leaves.withColumn("id", F.col("id").cast("string"))
    trees = _tiers(leaves, height)
    subroots = settle(trees[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "h"))
    groups = numbered(subroots, "grp", [F.col("name")])
    above = _tiers(groups, height)
    root = above[-1].select("h").first()
    top = above[-1].select("grp", "idx", F.lit("").alias("way"), F.lit("").alias("subroot"))

    def named(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("idx")
        return pd.DataFrame({"grp": nodes["name"], "idx": 0, "way": _ways(nodes, outer, height), "subroot": nodes["h"]})

    def finished(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        """Local levels, proofs and folds of a superblock of leaves."""
        nodes = nodes.sort_values("idx")
        h = nodes["h"].tolist()
        ways = _ways(nodes, outer, height)
        proofs = [digest(w.translate(_JOINED)) for w in ways]
        roots = [_folded(now or old, w) for now, old, w in zip(nodes["now"].tolist(), h, ways, strict=True)]
        out = {"id": nodes["id"], "leaf": h, "subroot": outer["subroot"].iloc[0], "proof_sha256": proofs, "folded_root": roots, "way": ways}
        return pd.DataFrame({k: v for k, v in out.items() if keep_proof or k != "way"})

    schema = "id string, leaf string, subroot string, proof_sha256 string, folded_root string" + (", way string" if keep_proof else "")
    found = _exchange(trees, _exchange(above, top, height).applyInPandas(named, _WAY), height).applyInPandas(finished, schema)
    told = [F.col("id").cast(kind).alias(id_col), "leaf", "subroot", F.lit(root and root[0]).cast("string").alias("root"), "proof_sha256", "folded_root"]
    found = found.select(*told, *(["way"] if keep_proof else [])).withColumn("verified", F.col("folded_root") == F.col("root"))
    if not keep_proof:
        return found
    step = lambda s: F.struct(F.element_at(F.split(s, r"\|", -1), 1).alias("left"), F.element_at(F.split(s, r"\|", -1), 2).alias("right"))
    steps = F.filter(F.split("way", ","), lambda s: s != "")
    return found.withColumn("proof", F.transform(steps, step)).drop("way")

