"""The named queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeforge.llm import conversations, licenses, packages, rolling_median
from lakeforge.llm.contamination import find_contamination
from lakeforge.llm.jaccard_join import near_duplicates
from lakeforge.llm.language_id import identify
from lakeforge.llm.ngram_lm import score_documents
from lakeforge.llm.pieces import encode_documents
from lakeforge.llm.substring_bytes import dedup_byte_strings
from lakeforge.llm.substring_words import dedup_word_windows
from lakeforge.llm.toxicity import classify
from lakeforge.llm.vptree import nearest

#: The order of the chain: a text of low quality, then a toxic one.
CATEGORIES = [("quality", 0), ("toxic", 1)]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_classifier_chain_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the chain's categories for every document."""
    return classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), CATEGORIES)


def op2_vp_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 rows of `embeddings` with the largest inner product, for every 20th vec_id; exact."""
    return nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, factor=1.0)


def op3_bloom_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram scores of every document, learned from those outside fold 2 of 7."""
    out = score_documents(_read(spark, sf_dir, "documents"), F.coalesce(_remainder(7) != 2, F.lit(True)))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_difference_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 20 words that also start earlier are removed from `documents`."""
    out = dedup_word_windows(_read(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence rules that hold in each document."""
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


def op6_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets link at 90 hundredths."""
    return near_duplicates(_read(spark, sf_dir, "documents"), shingle=3, percent=90)


def op7_sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with begin and end, and decoded."""
    out = encode_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of `benchmark` in each document."""
    return find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_viterbi_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those outside fold 0 of 5."""
    out = identify(_read(spark, sf_dir, "documents"), F.coalesce(_remainder(5) != 0, F.lit(True)))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes that also start anywhere else are removed from `documents`; repeated passages of over 50 words, many of them shorter, are counted."""
    out = dedup_byte_strings(_read(spark, sf_dir, "documents"), length=400, passages_over=(50, 259))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages", "n_passage_bytes")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`conversations`, damaged, and the cheapest repair of each."""
    return conversations.repair(conversations.damage(_read(spark, sf_dir, "conversations"))).withColumnRenamed("conv", "conv_id")


def op12_rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact medians and median deviations of the 360 minutes up to each click, by kind."""
    return rolling_median.rolling_medians(_read(spark, sf_dir, "clicks"))


def op13_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`pages` written as WARC records into ZIP packages and read back by ranges."""
    out = packages.round_trip(_read(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:2] == "op" and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op5_license_scan": licenses.oracle(), "op12_rolling_median": rolling_median.oracle(), "op13_warc_packages": packages.oracle()}
