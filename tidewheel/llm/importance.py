"""Quality classification by importance resampling.

Two generative models over hashed word unigrams and bigrams, one of target
text and one of all (raw) text, are multinomials over BUCKETS buckets. A
document's log importance weight is the sum over its n-grams of the log ratio
of the two. The sample is drawn without replacement with probabilities that
follow the weights, by Gumbel top-k: each row's weight plus a Gumbel variate
of its own, the k largest kept. A sum over more n-grams spreads more, with the
root of their number, so weights are compared at one length: divided by the
root of n_grams, times that of REFERENCE.

Raw counts cover every text. The target is labelled rows; at most
MAX_LABELLED of them (those whose hashed id is smallest) are used, and go to
the readers of the texts by broadcast. Four in five of them (by hash) make the target
model; on the others, which the model has not seen, a bar on the compared
weight is fitted that parts good from bad best, where a good row lost counts
twice. k is the number of documents
over that bar, or a share of all rows, if one is given. The least score of the
sample, the k-th largest of all, is found exactly by counting digits of the
scores in a few passes, without a global sort.

Gumbel variates are keyed by id and text, so a run can be repeated. Equal
scores go by id, and beyond that all rows equal in both are kept.

Edge cases. Null and empty texts have no n-grams, weight null and are never
kept; k counts rows with weights only. A null id is an id like any other.
Repeated rows share score and verdict. With no label of one kind the bar is
0. An empty table gives an empty table. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .words import Texts, in_groups, shingles

BUCKETS = 1 << 20
#: Labelled rows used for target and bar: the bound of what is broadcast.
MAX_LABELLED = 50_000
#: Added to a bucket's target count and to the count expected of it: rare n-grams tell little.
SMOOTHING = 5.0
#: n-grams of the length at which weights are compared.
REFERENCE = 600
SEED = 20_240_229


def _features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams, and the texts they are of."""
    words = texts.words()
    pairs, owner = shingles(words, texts.doc, 2)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    return (np.concatenate([words, pairs]) >> shift).astype("i4"), np.concatenate([texts.doc, owner])


def count_buckets(docs: DataFrame, id_col: str = "id") -> DataFrame:
    """bucket, raw, target: n-gram counts over all rows, and over those whose flag good is true."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), "i8")
        for batch in batches:
            good = np.asarray(batch.column(1).fill_null(False))
            for row, texts in in_groups(batch.column(0)):
                bucket, owner = _features(texts)
                sums[0] += np.bincount(bucket, minlength=BUCKETS)
                sums[1] += np.bincount(bucket[good[row : row + texts.n][owner]], minlength=BUCKETS)
        seen = np.flatnonzero(sums[0])
        for at in range(0, len(seen), 1 << 17):
            part = seen[at : at + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype("i4")), pa.array(sums[0, part]), pa.array(sums[1, part])], ["bucket", "raw", "target"])

    found = docs.select("text", "good").mapInArrow(work, "bucket int, raw bigint, target bigint")
    return found.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def models(counts: DataFrame, smoothing: float = SMOOTHING) -> np.ndarray:
    """Smoothed target counts, and counts expected of a target that is like raw text: 2 x BUCKETS numbers, whatever the corpus."""
    table = counts.toArrow()
    sums = np.zeros((2, BUCKETS))
    at = np.asarray(table["bucket"])
    sums[:, at] = np.asarray(table["target"]), np.asarray(table["raw"])
    sums[1] *= sums[0].sum() / max(sums[1].sum(), 1.0)
    return (sums + smoothing).astype("f4")


def weigh(docs: DataFrame, both: np.ndarray) -> DataFrame:
    """id, good, n_grams, log_weight, th of each row. docs: id, text, good, fits (part of the target: such a text is weighed as if it were not)."""
    shared = docs.sparkSession.sparkContext.broadcast(both)
    kind = docs.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, expected = shared.value
        ratios = np.log(target / expected)
        for batch in batches:
            counts, weights = [np.zeros(0, "i8")], [np.zeros(0)]
            fits = np.asarray(batch.column(3))
            for row, texts in in_groups(batch.column(1)):
                bucket, owner = _features(texts)
                found = np.bincount(owner, weights=ratios[bucket], minlength=texts.n)
                for i in np.flatnonzero(fits[row : row + texts.n]):
                    own, times = np.unique(bucket[owner == i], return_counts=True)
                    found[i] = (np.log(np.maximum(target[own] - times, 0.5) / expected[own]) * times).sum()
                counts.append(np.bincount(owner, minlength=texts.n))
                weights.append(found)
            n, w = np.concatenate(counts), np.concatenate(weights)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(np.where(n > 0, w, np.nan), pa.float64(), from_pandas=True), batch.column(4)], ["id", "good", "n_grams", "log_weight", "th"])

    return docs.select("id", "text", "good", "fits", F.xxhash64("text").alias("th")).mapInArrow(work, f"id {kind}, good boolean, n_grams bigint, log_weight double, th bigint")


def fit_bar(rows: list[tuple[float, bool]]) -> float:
    """The bar that parts good rows from others with the largest mean of both rates, that of good rows taken twice."""
    x, good = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], bool)
    if not len(x) or good.all() or not good.any():
        return 0.0
    order = np.argsort(x)
    x, good = x[order], good[order]
    right = np.cumsum(~good) / (~good).sum() - 2 * np.cumsum(good) / good.sum()
    best = int(np.argmax(right))
    return float((x[best] + x[min(best + 1, len(x) - 1)]) / 2)


def kth_largest(scores: DataFrame, col: str, k: int) -> int:
    """The k-th largest of a bigint column, exactly, by four passes that count 16 bits each."""
    known, bits = 0, 0
    biased = F.col(col).bitwiseXOR(F.lit(-(1 << 63)))  # so that unsigned order is the order of the column
    while bits < 64:
        here = scores.where(F.shiftrightunsigned(biased, 64 - bits) == known) if bits else scores
        digit = F.shiftrightunsigned(biased, 48 - bits).bitwiseAND(F.lit(0xFFFF))
        for r in here.groupBy(digit.alias("digit")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("digit")).collect():  # at most 65,536 rows
            if k <= r["n"]:
                known, bits = known << 16 | r["digit"], bits + 16
                break
            k -= r["n"]
    return (known ^ (1 << 63)) - (1 << 64) if known < 1 << 63 else known ^ (1 << 63)


def resample(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float | None = None, max_labelled: int = MAX_LABELLED, seed: int = SEED
) -> DataFrame:
    """id_col, n_grams, log_weight, score, kept. labels: id_col and good (boolean)."""
    chosen = labels.groupBy(F.col(id_col).alias("_id")).agg(F.min("good").alias("good"))
    chosen = chosen.orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(max_labelled)
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    chosen = settle(chosen.withColumn("fits", F.xxhash64("_id", F.lit(seed + 1)) % 5 != 0))
    marked = plain.join(F.broadcast(chosen), F.col("id") == F.col("_id"), "left")
    in_target = F.coalesce(F.col("good") & F.col("fits"), F.lit(False))
    both = models(count_buckets(marked.select("text", in_target.alias("good"))))
    weighed = weigh(marked.select("id", "text", F.when(~F.col("fits"), F.col("good")).alias("good"), in_target.alias("fits")), both)
    # a variate in (0, 1), the same wherever and however often it is computed
    uniform = (F.shiftrightunsigned(F.xxhash64("id", "th", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    compared = F.col("log_weight") * F.sqrt(REFERENCE / F.nullif(F.col("n_grams").cast("double"), F.lit(0.0)))
    score = compared - F.log(-F.log(uniform))
    # greatest and least pass over nulls
    rank = F.when(score.isNotNull(), F.floor(F.greatest(F.least(score, F.lit(1e9)), F.lit(-1e9)) * 1e9).cast("long"))
    weighed = settle(weighed.withColumn("compared", compared).withColumn("score", score).withColumn("rank", rank))
    able = weighed.where("log_weight is not null")
    if share is None:
        told = able.where("good is not null").select(F.col("compared").alias("w"), "good")
        # one row for each labelled row, of which there are at most max_labelled ids
        bar = fit_bar([(r["w"], r["good"]) for r in told.collect()])
        k = able.where(F.col("compared") > bar).count()
    else:
        k = round(able.count() * share)
    least = kth_largest(able, "rank", k) if k else None
    kept = F.coalesce(F.col("rank") >= least, F.lit(False)) if k else F.lit(False)
    return weighed.select(F.col("id").alias(id_col), "n_grams", "log_weight", "score", kept.alias("kept"))
