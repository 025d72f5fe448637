"""Sinks: batches that replace themselves, upserts by hash, quarantine, overwrite, compaction, run log.

Tables are versioned (`tables`); batches are folders of Parquet.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lakeforge.functions import cleaning as C
from lakeforge.sources.files import CORRUPT
from lakeforge.sources.tables import Table


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


#: Of a table that `merge_into` makes: an upsert rewrites those that it changes.
BUCKETS = 16


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A versioned table's latest version, or all batches of a folder of batches; columns that came later are null before."""
    held = Table(spark, path)
    if held.exists():
        return held.read()
    return spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(path)


def replace_batch(df: DataFrame, path: str, batch_id: str, rejected: str | None = None) -> dict:
    """Writes a batch in place of an earlier run of the same one, also where it has no rows now.

    Rows are counted as they are read and again from the files: {"rows_read", "rows_written", "rows_rejected"}. Where
    the reader kept records that it could not parse in `CORRUPT`, those rows are rejected: they go, as they were read,
    to the folder `rejected`, by default the table's with `_rejected` after its name. An id may have any signs.
    """
    seen = Observation()
    spark, folder = df.sparkSession, f"batch-{quote(batch_id, safe='')}"
    corrupt = F.col(CORRUPT) if CORRUPT in df.columns else F.lit(None).cast("string")
    rows = df.withColumn("_batch_id", F.lit(batch_id)).observe(seen, F.count(F.lit(1)).alias("n"), F.count(corrupt).alias("bad"))
    rows.where(corrupt.isNull()).drop(CORRUPT).write.mode("overwrite").parquet(f"{path}/{folder}")
    read, bad = seen.get["n"], seen.get["bad"]
    apart = f"{rejected or path.rstrip('/') + '_rejected'}/{folder}"
    if bad or exists(spark, apart):  # an earlier run's rejects are replaced too
        held = [c for c in df.columns if c.startswith("_") and c not in (CORRUPT, "_batch_id")]
        df.where(corrupt.isNotNull()).select(corrupt.alias(CORRUPT), *held, F.lit(batch_id).alias("_batch_id")).write.mode("overwrite").parquet(apart)
    written = spark.read.parquet(f"{path}/{folder}").count()
    if read != written + bad:
        raise OSError(f"{path}: {read} rows were read, {written} written and {bad} rejected")
    return {"rows_read": read, "rows_written": written, "rows_rejected": bad}


def overwrite(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """The table becomes `df`, which may read it, as its next version: who reads meanwhile sees the one before."""
    Table(df.sparkSession, path).overwrite(df, partition_by=partition_by)


def merge_into(df: DataFrame, path: str, keys: list[str], partition_by: list[str] | None = None, order: str | None = None, buckets: int = BUCKETS) -> dict:
    """Upsert by key and row hash: {"created", "rows", "inserted", "updated"}. Unchanged batches write nothing.

    Of rows with one key the latest by `order` counts; without it they raise.
    """
    held = Table(df.sparkSession, path)
    created = not held.exists()
    if created:  # an empty table, so that the first batch is held to the same rules
        held.overwrite(df.limit(0), keys, buckets, partition_by)
    got = held.merge(df, order)
    return {"created": created, "rows": table_metrics(df.sparkSession, path)["rows"], "inserted": got["inserted"], "updated": got["updated"]}


def append_quarantine(bad: DataFrame, path: str, key: str, batch_id: str) -> int:
    """Adds a batch's bad rows with their key, reason and time; returns how many."""
    out = bad.withColumns({"_business_key": F.col(key).cast("string"), "_quarantine_reason": F.col("quarantine_reason"), "_quarantine_ts": F.current_timestamp()}).drop("quarantine_reason")
    return replace_batch(out, path, batch_id)["rows_written"]


def table_metrics(spark: SparkSession, path: str) -> dict:
    """Files, bytes and rows of a table's latest version, from its manifest; `Table.history` has those of all versions."""
    files = Table(spark, path).snapshot().files
    return {"files": len(files), "bytes": sum(f.n_bytes for f in files), "rows": sum(f.rows for f in files)}


def compact(spark: SparkSession, path: str, key: str | list[str], file_bytes: int = 128 << 20) -> dict:
    """Rewrites a table in files of about `file_bytes`, clustered by one key or several, so that scans by any of them skip files: metrics before and after."""
    before = table_metrics(spark, path)
    Table(spark, path).cluster([key] if isinstance(key, str) else key, file_bytes)
    return {"before": before, "after": table_metrics(spark, path)}


def high_water(df: DataFrame, column: str | None, folders: list[str] | None = None) -> str | None:
    """The mark up to which a feed was read: the last dated folder, else the latest time of the column, parsed first, as ISO text."""
    if folders:
        return folders[-1].rstrip("/").rsplit("/", 1)[-1]
    if not column:
        return None
    time_ = F.coalesce(C.parse_timestamp(F.col(column)), C.parse_date(F.col(column)).cast("timestamp"))
    return df.agg(F.date_format(F.max(time_), "yyyy-MM-dd HH:mm:ss")).first()[0]


def run_steps(spark: SparkSession, batch_id: str, steps: list[tuple[str, Callable[[], dict | None]]], log_path: str) -> DataFrame:
    """Runs steps in their order and logs each: status, times, rows read and written, error. A step that fails ends the run.

    The log is written also when a step fails, and the failure is raised afterwards.
    """
    rows, failed = [], None
    for name, run in steps:
        began = time.time()
        try:
            got = run() or {}
            rows.append((batch_id, name, "SUCCEEDED", got.get("rows_read"), got.get("rows_written"), began, time.time(), None))
        except Exception as why:  # noqa: BLE001, logged, then raised
            rows.append((batch_id, name, "FAILED", None, None, began, time.time(), str(why)[:4000]))
            failed = why
            break
    log = spark.createDataFrame(rows, "batch_id string, step string, status string, rows_read long, rows_written long, began double, ended double, error string")
    log.write.mode("append").parquet(log_path)
    if failed is not None:
        raise failed
    return log
