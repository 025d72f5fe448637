"""A corpus pipeline: toxic texts out, near copies out, repeated passages out, benchmark passages out, then pieces.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the
columns of `documents`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeforge.llm.blocks import checkpoint, ensure_checkpoint_dir
from lakeforge.llm.contamination import find_contamination
from lakeforge.llm.jaccard_join import near_duplicates
from lakeforge.llm.pieces import encode_documents
from lakeforge.llm.queries import CATEGORIES
from lakeforge.llm.substring_bytes import dedup_byte_strings
from lakeforge.llm.toxicity import classify

#: Repeated passages of more than so many words, or so many bytes where words are long or not spaced, are cut.
PASSAGE_WORDS, PASSAGE_BYTES = 50, 259
#: No passage of more than PASSAGE_WORDS words is shorter.
SHORTEST = 2 * PASSAGE_WORDS + 1
#: A row's number within a stage: stages decide by row, whatever its doc_id.
ROW = "row_of_stage"


def _free(docs: DataFrame, *names: str) -> str:
    """A suffix with which no column of `docs` has one of these names."""
    out = ""
    while any(n + out in docs.columns for n in names):
        out += "_"
    return out


def _numbered(docs: DataFrame) -> DataFrame:
    """Written once, so that a row has one number wherever the stage reads it."""
    return checkpoint(docs.withColumn(ROW, F.monotonically_increasing_id()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the last model of the chain rejects go. Null and empty texts stay, unless most texts are toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    suffix = _free(docs, "rejected", *(f"p_{c}" for c, _ in CATEGORIES))
    return classify(docs, labels, CATEGORIES, keep=docs.columns, suffix=suffix).where(~F.col(f"rejected{suffix}")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with a similarity of 0.8 or more by 5-word shingles, the one with the least id stays.

    One row of it, that is, of rows with that id; null ids come last.
    """
    rows = _numbered(docs)
    groups = near_duplicates(rows, id_col=ROW, shingle=5, percent=80).select(ROW, "component_id")
    # alone in its group: stays; most rows are, and are not joined
    many = groups.where(F.col(ROW) != F.col("component_id"))
    members = many.unionByName(many.select(F.col("component_id").alias(ROW), "component_id").distinct())
    ranked = members.join(rows.select(ROW, "doc_id"), ROW).select("component_id", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", ROW).alias("at"))
    stays = ranked.groupBy("component_id").agg(F.min("at").alias("at")).select(F.col("at")[ROW].alias(ROW))
    gone = members.select(ROW).join(stays, ROW, "left_anti")
    return rows.join(gone, ROW, "left_anti").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of the texts; a document that is left without a letter or digit of any script goes.

    No copy is kept, not the first either: a passage that documents share is in none of them afterwards.
    """
    suffix = _free(docs, "n_bytes", "n_removed", "n_spans", "kept", "no_text")
    keep = [*(c for c in docs.columns if c != "text"), f"no_text{suffix}"]
    out = dedup_byte_strings(docs.withColumn(keep[-1], F.col("text").isNull()), length=SHORTEST, only_over=(PASSAGE_WORDS, PASSAGE_BYTES), keep=keep, suffix=suffix)
    cut = F.col(f"n_removed{suffix}") > 0
    out = out.withColumn("text", F.when(~F.col(keep[-1]), F.col(f"kept{suffix}").cast("string")))
    out = out.where(~cut | F.col("text").rlike(r"[\p{L}\p{N}]"))
    new = {"n_chars": F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return out.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    rows = _numbered(docs)
    found = find_contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=ROW).select(ROW).distinct()
    return rows.join(found, ROW, "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each text."""
    out = encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_tokens", "ids", (F.col("decoded")).alias("text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("drop_toxic", drop_toxic),
    ("drop_near_copies", drop_near_copies),
    ("cut_repeated_passages", cut_repeated_passages),
    ("drop_contaminated", drop_contaminated),
    ("encode", encode),
]

#: The chain's models are fitted, and components are found by iteration: no stage but the last two could be SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each keeps is written to the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
