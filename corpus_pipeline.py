"""The corpus pipeline: rules, line dedup, near-duplicate removal, PII, packing.

Each stage works on all rows the one before it kept; run() writes each stage's
rows as Parquet in the shared folder and reads them again, and drops a
stage's folder once the next is written. All stages but the last return the
columns of documents; the last returns the packed pieces.

Edge cases, for all stages: an empty table gives an empty table, further
columns pass through whatever they are called (packing leaves them out), a
null id is an id like any other, and no length of text is cut. What nulls,
empty texts, ties and repeated rows become is told with each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.bin_slack import pack_documents
from tidewheel.llm.common import ensure_checkpoint_dir, read_table
from tidewheel.llm.line_dedup import drop_repeated_lines
from tidewheel.llm.ngram_join import keep_first
from tidewheel.llm.perplexity import keep_good
from tidewheel.llm.queries import surrogate_key, vocabulary
from tidewheel.llm.surrogates import replace_pii


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars made true again after texts have changed."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or their language's perplexity band go.

    Null and empty texts have no words and go. A null language is one of its
    own. Repeated rows get one verdict each, the same. A perplexity on the end
    of a band is inside.
    """
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go, documents stay.

    Null texts stay null, and a text whose lines all go is empty. Of equal runs
    the first by (doc_id, text hash, line) stays. Rows that repeat id and text
    lose the same lines.
    """
    return _measured(drop_repeated_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts stays, the one with the smallest id (null is smallest).

    Equal texts without words, nulls included, are a class. Similarity of just
    0.8 links. Of rows that repeat id and text one stays.
    """
    return keep_first(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become surrogates.

    Null texts stay null, texts without findings stay as they are. Of findings
    that overlap the first counts. Repeated rows get equal texts.
    """
    return _measured(replace_pii(docs, surrogate_key(spark)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that are left, packed.

    A null or empty text is its end id alone. Repeated rows are packed each.
    Pieces of one length are interchangeable: their order is by id, piece and content.
    """
    return pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", pii),
    ("best-fit packing", packing),
]

#: A language model, a tokenizer and a keyed hash cannot be said in SQL; the tests hold every stage of run() against plain Python.
ORACLE_SQL = None


def _drop_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:
            _drop_folder(spark, f"{folder}/{number - 1}")
    return docs
