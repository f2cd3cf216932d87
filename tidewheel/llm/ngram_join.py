"""N-gram Jaccard self-join by MinHash banding.

A text is the set of its runs of NGRAM words, or of all its words together if
it has fewer. Texts with equal sets are copies; they are one node from here
on. Nodes meet if any of their bands of MinHash rows agree; bands and rows are
chosen so that a pair at the threshold meets with probability RECALL at least.
Band hashes are shuffled, and each bucket links its members to its smallest
one, never all to all. Candidates then bring their full n-gram sets
together and are verified exactly. A connected group of candidates that fits
in one block is verified there. A larger one is cut into blocks around its
buckets, and two blocks meet only if members of both share a band: so a chain of chance matches costs its own
length, not its square, while a true group of near copies meets block by block
in any number of tasks. Pairs are counted where they are verified, never
listed.

A document's links are the documents, copies included, at the threshold or
above; its class is the connected component of links, named by the smallest
id in it.

Edge cases. Texts without words (null, empty, blank) have no n-grams, no links
and a class of their own, the id of their row. Repeated rows (same id and
text) count once each as documents. A null id is the smallest id, and a class
may have the id null. Similarity equal to the threshold links. An empty table
gives an empty table. Further columns are ignored by similar_groups() and kept
by keep_first(), whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_KEYS, drop_rows, one_of_each, row_count, settle, split_heavy, take_rows
from .components import components
from .words import Texts, in_groups, mix, shingles

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.9995
#: Documents, and n-grams, that a block of a candidate group may hold.
BLOCK, BLOCK_GRAMS = 256, 1_500_000


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 256) -> tuple[int, int]:
    """Bands and rows: the most rows a band for which few enough hashes reach the recall at the threshold."""
    best = (1, 1)
    for rows in range(1, most + 1):
        meet = threshold**rows
        bands = 1 if meet >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - meet))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def gram_sets(texts: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of each text, sorted, one text after another; and where each text's begin."""
    words = texts.words()
    grams, owner = shingles(words, texts.doc, n)
    counts = np.bincount(texts.doc, minlength=texts.n)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        first = np.searchsorted(texts.doc, short)
        whole = [mix(np.bitwise_xor.accumulate(mix(words[a : a + k] + np.arange(k, dtype=np.uint64)))[-1:] + np.uint64(k)) for a, k in zip(first, counts[short], strict=True)]
        grams, owner = np.concatenate([grams, *whole]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(texts.n + 1))


def _node(grams: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(grams ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    return mix(sums[begin[1:]] - sums[begin[:-1]] + np.diff(begin).astype(np.uint64)).view("i8")


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """id, th, node, n_grams, bands of each row. docs: id, text."""
    kind = docs.schema["id"].dataType.simpleString()
    seeds = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64)).astype("u4")
    scale, shift = seeds[: bands * rows] | np.uint32(1), seeds[bands * rows :]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, hashes = [np.zeros(0, "i8")], [np.zeros(0, "i8")], [np.zeros((0, bands), "i8")]
            for _, texts in in_groups(batch.column(1)):
                grams, begin = gram_sets(texts, n)
                size, node = np.diff(begin), _node(grams, begin)
                # copies within the group are worked out once
                _, first, which = np.unique(np.where(size > 0, node, 0), return_index=True, return_inverse=True)
                held = first[size[first] > 0]
                signature = np.zeros((texts.n, bands), "i8")
                if len(held):
                    low = np.concatenate([grams[begin[i] : begin[i + 1]] for i in held]).astype("u4")
                    starts = np.concatenate([[0], np.cumsum(size[held])[:-1]])
                    for band in range(bands):
                        key = np.full(len(held), np.uint64(band))
                        for j in range(band * rows, (band + 1) * rows):
                            key = mix(key * np.uint64(3) + np.minimum.reduceat(low * scale[j] + shift[j], starts))
                        signature[held, band] = key.view("i8")
                    signature = signature[first[which]]
                nodes.append(node)
                sizes.append(size)
                hashes.append(signature)
            flat = pa.array(np.concatenate(hashes).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype="i4")), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sizes).astype("i8")), lists], ["id", "th", "node", "n_grams", "bands"])

    return docs.select("id", "text", F.xxhash64("text").alias("th")).mapInArrow(work, f"id {kind}, th bigint, node bigint, n_grams bigint, bands array<bigint>")


def candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node, h, hub, n: the band hashes that nodes share with others, the smallest node there and how many; and node, root: connected groups of them."""
    rows = settle(nodes.select("node", F.explode("bands").alias("h")))
    buckets = rows.groupBy("h").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    heavy, rest = split_heavy(rows, settle(buckets), "h", row_count(rows), "n")
    shared = settle(heavy.unionByName(rest))
    return shared, components(shared.selectExpr("node a", "hub b"))


def _meetings(large: DataFrame, shared: DataFrame) -> DataFrame:
    """node, block, ends (the pairs of blocks it goes to) of the nodes of large groups. large: node, n_grams, root, parts."""
    near = settle(shared.join(large.select("node"), "node", "left_semi"))
    anchors = near.groupBy("node").agg(F.max(F.struct("n", "hub"))["hub"].alias("anchor"))
    at = settle(large.join(anchors, "node"))
    sums = at.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), F.sum("n_grams").alias("grams"))
    heavy, rest = split_heavy(at, settle(sums.select("anchor", "k", _parts().alias("own"))), "anchor", row_count(at), "k")
    # nodes around a bucket that fills blocks get blocks of their own, other buckets share blocks
    full = F.xxhash64("anchor", F.pmod(F.xxhash64("node"), F.col("own")))
    block = F.when(2 * F.col("k") > BLOCK, full).otherwise(F.xxhash64("root", F.pmod(F.xxhash64("anchor"), F.col("parts"))))
    placed = settle(heavy.unionByName(rest).select("node", block.alias("block")))
    # blocks, not nodes, are paired
    met = settle(near.select("node", "h").join(placed, "node").select("h", "block").distinct())
    pairs = met.toDF("h", "a").join(met.toDF("h", "b"), "h").where("a <= b").select("a", "b").distinct()
    pairs = pairs.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("block"), F.struct("a", "b").alias("end"))
    return placed.join(pairs.groupBy("block").agg(F.collect_list("end").alias("ends")), "block")


def _parts() -> Column:
    return F.greatest(F.ceil(F.col("k") / BLOCK), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")


def _verify(sets: list[np.ndarray], copies: np.ndarray, left: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each set to others, links counted with their copies, and the number of its component; between left and others if both are there, else between all."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, which, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[which] > 1  # an n-gram that one set alone has is in no intersection
    column = np.cumsum(often > 1)[which[shared]] - 1
    owner = owner[shared]
    common = np.zeros((len(sets), len(sets)), "f4")
    by_column = np.argsort(column, kind="stable")
    column, owner = column[by_column], owner[by_column]
    width = 8192
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        part = np.zeros((len(sets), width), "f4")
        part[owner[a:b], column[a:b] - at] = 1
        common += part @ part.T
    union = size[:, None] + size[None, :] - common
    link = common >= threshold * union - 1e-6
    np.fill_diagonal(link, False)
    if left.any() and not left.all():
        link &= left[:, None] != left[None, :]
    label = np.arange(len(sets))
    while True:
        lower = np.minimum(label, np.where(link, label[None, :], len(sets)).min(1))
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    return link.sum(1), link @ copies, label


def verified(docs: DataFrame, nodes: DataFrame, shared: DataFrame, groups: DataFrame, n: int, threshold: float) -> DataFrame:
    """node, other, texts, docs: links of each node found in one task, and a node it is connected to there."""
    members = settle(groups.join(nodes.select("node", "n_copies", "n_grams", "rep"), "node"))
    sums = members.groupBy("root").agg(F.count(F.lit(1)).alias("k"), F.sum("n_grams").alias("grams"))
    heavy, rest = split_heavy(members, settle(sums.select("root", "k", _parts().alias("parts"))), "root", row_count(members), "k")
    told = ["node", "n_copies", F.col("rep.id").alias("rep_id"), F.col("rep.th").alias("rep_th")]
    placed = settle(heavy.unionByName(rest).select(*told, "root", "parts", "n_grams"))
    block = F.xxhash64("root")
    rep = placed.where("parts = 1").withColumn("block", block).withColumn("ends", F.array(F.struct(block.alias("a"), block.alias("b")))).drop("parts", "n_grams", "root")
    large = settle(placed.where("parts > 1"))
    if row_count(large):
        rep = rep.unionByName(large.drop("n_grams", "root", "parts").join(_meetings(large.select("node", "n_grams", "root", "parts"), shared), "node"))
    # the one shuffle of texts: each node's first document finds its text
    own = docs.select("id", "text", F.xxhash64("text").alias("th"))
    texts = own.join(rep, F.col("id").eqNullSafe(F.col("rep_id")) & F.col("th").eqNullSafe(F.col("rep_th")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, begins, base = [np.zeros(0, np.uint64)], [np.zeros(1, "i8")], 0
            for _, group in in_groups(batch.column(4)):
                grams, begin = gram_sets(group, n)
                found.append(grams)
                begins.append(begin[1:] + base)
                base += len(grams)
            lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate(begins)), pa.array(np.concatenate(found).view("i8"))).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], lists], ["node", "n_copies", "block", "ends", "grams"])

    held = texts.select("node", "n_copies", "block", "ends", "text").mapInArrow(sets, "node bigint, n_copies bigint, block bigint, ends array<struct<a: bigint, b: bigint>>, grams array<bigint>")
    held = held.select(F.explode("ends").alias("end"), "block", "node", "n_copies", "grams").select("end.a", "end.b", "block", "node", "n_copies", "grams")
    dealt = held.repartition("a", "b").sortWithinPartitions("a", "b", "node")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(key: tuple, rows: dict[int, tuple]) -> pa.RecordBatch:
            ids = np.array(list(rows))
            left = np.array([r[0] == key[0] for r in rows.values()])
            copies = np.array([r[1] for r in rows.values()], "i8")
            if key[0] != key[1] and (left.all() or not left.any()):
                links, weighed, label = np.zeros(len(ids), "i8"), np.zeros(len(ids), "i8"), np.arange(len(ids))
            else:
                links, weighed, label = _verify([r[2] for r in rows.values()], copies, left, threshold)
            on = links > 0
            return pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(ids[label][on]), pa.array(links[on].astype("i8")), pa.array(weighed[on].astype("i8"))], ["node", "other", "texts", "docs"])

        key, rows = None, {}
        for batch in batches:
            a, b, block, node, copies = (batch.column(c).to_pylist() for c in range(5))
            grams = batch.column(5)
            values, begin = np.asarray(grams.values), np.asarray(grams.offsets)
            for k in range(batch.num_rows):
                at = (a[k], b[k])
                if at != key:
                    if len(rows) > 1:
                        yield told(key, rows)
                    key, rows = at, {}
                rows[node[k]] = (block[k], copies[k], values[begin[k] : begin[k + 1]].copy())  # a repeated row changes nothing
        if len(rows) > 1:
            yield told(key, rows)

    return dealt.mapInArrow(check, "node bigint, other bigint, texts bigint, docs bigint")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """id_col, class_id, n_links, n_text_links, is_first, th (text hash), worded: one row for each row of docs.

    n_links counts documents, n_text_links different texts (copies apart);
    is_first marks the row (or equal rows) that a class is named after.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = settle(signatures(plain, n, *banding(threshold, recall)))
    first = F.struct(F.col("id").isNotNull().alias("known"), "id", "th")
    nodes = settle(
        signed.where("n_grams > 0")
        .groupBy("node", "n_grams")
        .agg(F.count(F.lit(1)).alias("n_copies"), F.min(first).alias("rep"), F.first("bands").alias("bands"))
    )
    links = settle(verified(plain, nodes, *candidates(nodes), n, threshold))
    sums = links.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    classes = components(links.selectExpr("node a", "other b"))
    named = nodes.select("node", "n_copies", "rep").join(sums, "node", "left").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = settle(named)
    names = settle(named.groupBy("root").agg(F.min("rep").alias("class"), F.count(F.lit(1)).alias("k")))
    heavy, rest = split_heavy(named, names, "root", row_count(named), "k")
    links_of = F.coalesce("docs", F.lit(0)) + F.col("n_copies") - 1
    told = settle(heavy.unionByName(rest).select("node", "class", links_of.alias("links"), F.coalesce("texts", F.lit(0)).alias("texts"), "n_copies"))
    rows = settle(signed.select("id", "th", F.when(F.col("n_grams") > 0, F.col("node")).alias("node")))
    heavy, rest = split_heavy(rows.where("node is not null"), told, "node", row_count(rows), "n_copies")
    out = heavy.unionByName(rest).unionByName(rows.where("node is null"), allowMissingColumns=True)
    lone = F.col("class").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(lone, F.col("id")).otherwise(F.col("class.id")).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_text_links"),
        (lone | (F.col("class.id").eqNullSafe(F.col("id")) & F.col("class.th").eqNullSafe(F.col("th")))).alias("is_first"),
        "th",
        F.col("node").isNotNull().alias("worded"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """One row of docs for each class of similar texts: the one with the smallest id. Of texts without words, equal ones are a class here."""
    rows = settle(similar_groups(docs, id_col, text_col, n, threshold).select(F.col(id_col).alias("id"), "th", "is_first", "worded"))
    order = F.struct(F.col("id").isNotNull().alias("known"), "id")
    blank = rows.where(~F.col("worded"))
    least = settle(blank.groupBy("th").agg(F.min(order).alias("first")))
    later = blank.join(F.broadcast(least) if row_count(least) <= MAX_KEYS else least, "th").where(order > F.col("first"))
    gone = rows.where("worded and not is_first").select("id", "th").unionByName(later.select("id", "th")).distinct()
    found = [F.col(id_col), F.xxhash64(F.col(text_col).cast("string"))]
    kept = drop_rows(docs, gone, found)
    twins = settle(rows.groupBy("id", "th").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "th"))
    if not row_count(twins):
        return kept
    return drop_rows(kept, twins, found).unionByName(one_of_each(take_rows(kept, twins, found), found))
