"""Line dedup by winnowing over line hashes. DataFrame functions only.

A document is the sequence of its lines that hold a word. A window is the
shortest stretch of such lines with min_words words or more, from some line on
or up to some line. The smallest line hash of a window is its fingerprint, so
two texts that share a run of whole lines of at least min_words words share a
fingerprint for certain; a window whose fingerprint stands at one place of the
corpus alone is dropped at once, and most are.

Positions that share a fingerprint are joined, and the content of the windows
around them is compared, by 128 bits of hash over all their lines; a match
reaches both ways over it: windows that begin at a line carry it forward,
windows that end at a line backward. A run that repeats an earlier one is just
the union of its windows, so every later run of min_words words or more goes,
whichever text it repeats, in the order (doc_id, text hash, line). A deleted
line always equals an earlier one, so the first copy of each line stays.

Lines match as wholes: a passage inside a line, or one whose whole lines hold
fewer than min_words words, stays.

Edge cases. Null text: the row is kept as it is, with no lines. Empty text:
one empty line, kept. Blank lines never match by themselves; those inside a
deleted run go with it. Rows that repeat both doc_id and text count once as a
source and lose the same lines. A null doc_id is an id like any other, the
first in order. An empty table gives an empty table. Further columns pass
through, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MAX_KEYS, free_names, quoted, row_count, settle, split_heavy, word_count

MIN_WORDS = 50


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each line that holds a word: d, th, pos, lh and lh2 (hashes of the trimmed line), words."""
    keyed = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("th")).where("t is not null")  # a hash here is one a text, not one a line
    lines = keyed.select("d", "th", F.posexplode(F.split("t", "\n", -1)).alias("pos", "line"))
    trimmed = F.trim("line")
    return lines.select("d", "th", "pos", F.xxhash64(trimmed).alias("lh"), F.xxhash64(F.lit(1), trimmed).alias("lh2"), word_count(F.col("line")).alias("words")).where("words > 0")


def windows(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every window: d, th, first_line, last_line, print (its smallest line hash), spot (where that stands), key and key2 (hashes of its content)."""
    doc = Window.partitionBy("d", "th").orderBy("pos")
    before, whole = doc.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("d", "th")
    placed = (
        lines.repartition("d", "th")
        .dropDuplicates(["d", "th", "pos"])
        .withColumn("cs", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .withColumn("ce", F.col("cs") + F.col("words"))
        .withColumn("rest", F.sum("words").over(whole) - F.col("ce"))
    )
    # words before a line, and up to it, grow strictly: a window is a range of either
    line = F.struct("pos", "lh", "lh2")
    ahead = Window.partitionBy("d", "th").orderBy("cs").rangeBetween(0, min_words - 1)
    behind = Window.partitionBy("d", "th").orderBy("ce").rangeBetween(-(min_words - 1), 0)
    both = placed.withColumn("f", F.when(F.col("rest") + F.col("words") >= min_words, F.collect_list(line).over(ahead)))
    both = both.withColumn("b", F.when(F.col("ce") >= min_words, F.collect_list(line).over(behind)))
    held = both.select("d", "th", F.explode(F.array("f", "b")).alias("w")).where("w is not null")
    least = F.array_min(F.transform("w", lambda x: F.struct(x["lh"].alias("lh"), x["pos"].alias("pos"))))
    content = lambda name: F.xxhash64(F.transform("w", lambda x: x[name]))
    return held.select(
        "d", "th", F.element_at("w", 1)["pos"].alias("first_line"), F.element_at("w", -1)["pos"].alias("last_line"), least["lh"].alias("print"), least["pos"].alias("spot"), content("lh").alias("key"), content("lh2").alias("key2")
    )


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Later repeated runs, disjoint: d, th, first_line, last_line."""
    found = settle(windows(line_table(docs, id_col, text_col), min_words))
    at = lambda pos: F.struct(F.col("d").isNotNull().alias("known"), "d", "th", pos)
    prints = found.groupBy("print").agg(F.count(F.lit(1)).alias("n"), F.min(at("spot")).alias("a"), F.max(at("spot")).alias("z")).where("a <> z").select("print", "n")
    heavy, rest = split_heavy(found, settle(prints), "print", row_count(found), "n")
    held = settle(heavy.drop("n").unionByName(rest.drop("n")).select("d", "th", "first_line", "last_line", F.struct("print", "key", "key2").alias("key")))
    # windows of equal content are as long, whichever way they were made, so they begin and end at matching lines
    spots = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(at("first_line")).alias("first")).where("n > 1")
    pairs = [p.where(at("first_line") > F.col("first")).select("d", "th", "first_line", "last_line") for p in split_heavy(held, settle(spots), "key", row_count(held), "n")]
    doc = Window.partitionBy("d", "th").orderBy("first_line", "last_line")
    reach = F.max("last_line").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    runs = pairs[0].union(pairs[1]).distinct().repartition("d", "th").withColumn("new", (F.coalesce(reach, F.lit(-2)) + 1 < F.col("first_line")).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("d", "th", "run").agg(F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line")).drop("run")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, report: bool = False) -> DataFrame:
    """docs with later repeated runs cut out of text_col; with report, also n_lines and n_removed (bigint).

    Up to MAX_KEYS cuts come to where the texts lie; beyond that the texts are
    shuffled once, to meet their cuts.
    """
    runs = settle(repeated_runs(docs, id_col, text_col, min_words))
    few = row_count(runs) <= MAX_KEYS
    d, th, cuts, lines = free_names(docs, 4)
    found = runs.groupBy("d", "th").agg(F.array_sort(F.collect_list(F.struct("first_line", "last_line")))).toDF(d, th, cuts)
    met = docs.join(F.broadcast(found) if few else found.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col(d)) & (F.xxhash64(text_col) == F.col(th)), "left")
    starts = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda c: c["last_line"] + 1))
    ends = F.concat(F.transform(cuts, lambda c: c["first_line"]), F.array(F.size(lines)))
    left = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a)))
    cut = met.withColumn(lines, F.when(F.col(cuts).isNotNull(), F.split(text_col, "\n", -1))).withColumn(
        text_col, F.when(F.col(cuts).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    )
    if not report:
        return cut.select(*quoted(docs.columns))
    gone = F.coalesce(F.aggregate(cuts, F.lit(0), lambda s, c: s + c["last_line"] - c["first_line"] + 1), F.lit(0)).cast("long")
    now = F.coalesce(F.regexp_count(text_col, F.lit("\n")) + 1, F.lit(0)).cast("long")
    every = F.when(F.col(lines).isNotNull(), F.size(lines).cast("long")).otherwise(now)
    return cut.select(*quoted(docs.columns), every.alias("n_lines"), gone.alias("n_removed"))
