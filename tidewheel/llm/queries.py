"""The dealt operators as queries over whole tables, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

import functools
import secrets
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .bin_slack import pack_documents
from .byte_bpe import encode_documents
from .chat_repair import damaged, repair
from .chat_windows import format_conversations, read_back
from .common import read_table
from .importance import resample
from .line_dedup import drop_repeated_lines
from .merkle import manifest
from .ngram_join import similar_groups
from .perplexity import judge
from .piecewise import splice_and_compare
from .sql import CHAT_REPAIR, CHAT_WINDOWS, LINE_DEDUP, MERKLE_MANIFEST, NGRAM_JOIN
from .surrogates import replace_pii
from .token_counts import count_tokens


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on this machine; each executor has it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its later repeated runs of lines cut out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs, report=True)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight and verdict of every document; the target is labelled good and not toxic."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    return resample(read_table(spark, sf_dir, "documents"), labels.where("good is not null"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of every document, encoded whole."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, vocabulary("byte_bpe_50k.tiktoken"), token_pattern())


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, perplexity and verdict of every document, under a model of all of them."""
    return judge(read_table(spark, sf_dir, "documents"))


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from the formatted windows of all conversations and conversation -1."""
    chats = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text")
    )
    return read_back(format_conversations(chats.unionByName(probe)))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, vocabulary("word_bpe_49k.json"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest other vectors, by cosine, of every vector whose id is divisible by 50."""
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_documents(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), token_pattern(), keep_ids=False)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document: five-word n-grams, Jaccard 0.8 or more."""
    return similar_groups(read_table(spark, sf_dir, "documents")).drop("th", "worded")


@functools.lru_cache
def _drawn_key(application: str) -> str:
    """A random key for one Spark application."""
    warnings.warn("spark.tidewheel.surrogateKey is not set: a random key holds for this application, its surrogates cannot be made again", stacklevel=3)
    return secrets.token_hex(32)


def surrogate_key(spark: SparkSession) -> str:
    """The secret of surrogates: the session's spark.tidewheel.surrogateKey.

    Without it a local master takes a word that anyone can read here, so that
    trials can be repeated. A cluster draws a key that nobody knows and keeps it
    for the application: its queries agree, those of another do not.
    """
    key = spark.conf.get("spark.tidewheel.surrogateKey", None)
    if key:
        return key
    return "not-a-secret" if spark.sparkContext.master.startswith("local") else _drawn_key(spark.sparkContext.applicationId)


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data and secrets replaced by surrogates."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_pii(docs, surrogate_key(spark), report=True)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its text with the second half replaced by the next document's beginning."""
    return splice_and_compare(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document; a copy in which every second text has lost its line feeds is verified."""
    second = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(second, F.replace("text", F.lit("\n"))).otherwise(F.col("text"))
    return manifest(read_table(spark, sf_dir, "documents"), changed={"text": text})


def op13_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after damage."""
    chats = read_table(spark, sf_dir, "conversations")
    return repair(damaged(chats), chats)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_token_counts": op3_token_counts,
    "op4_quality_rules": op4_quality_rules,
    "op5_chat_windows": op5_chat_windows,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_ngram_join": op9_ngram_join,
    "op10_pii_surrogates": op10_pii_surrogates,
    "op11_fingerprints": op11_fingerprints,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_chat_repair": op13_chat_repair,
}

#: The others need a tokenizer, a model, random projections or a keyed hash; the tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op1_line_dedup": LINE_DEDUP,
    "op5_chat_windows": CHAT_WINDOWS,
    "op9_ngram_join": NGRAM_JOIN,
    "op12_merkle_manifest": MERKLE_MANIFEST,
    "op13_chat_repair": CHAT_REPAIR,
}
