"""Metadata-driven reads of raw feeds, audit columns, and batch-replacing writes."""

from __future__ import annotations

import codecs
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeforge.functions.cleaning import parse_date, parse_timestamp, row_hash
from lakeforge.sources.workbooks import FILE, SHEET, read_workbooks


@dataclass(frozen=True)
class Feed:
    name: str
    system: str
    path: str
    format: str = "csv"
    header: bool = True
    delimiter: str = ","
    encoding: str = "utf-8"
    sheet: str | None = None
    keys: tuple[str, ...] = ()
    watermark_column: str | None = None
    dated_folders: bool = False
    load_order: int = 0
    active: bool = True


#: Encodings, by Python's names, that Spark's reader knows, and that take more than a byte a sign or are Latin-1 itself.
_WIDE = {"utf-8", "utf-16", "utf-16-le", "utf-16-be", "utf-32", "ascii", "iso8859-1"}


def active_feeds(feeds: list[Feed], system: str | None = None) -> list[Feed]:
    return sorted((f for f in feeds if f.active and system in (None, f.system)), key=lambda f: f.load_order)


#: Holds a record that the reader could not parse, as it was read; null for others.
CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, feed: Feed, paths: list[str]) -> DataFrame:
    """All columns as strings, and `CORRUPT`: lines with more or fewer fields than the first file's header.

    Single-byte encodings that Spark doesn't know, such as windows-1254, are read byte by byte as Latin-1, and the
    fields' signs are then replaced: no session setting is needed, and files of several encodings may be read side by
    side. What an encoding doesn't define becomes U+FFFD.
    """
    narrow = codecs.lookup(feed.encoding).name not in _WIDE
    encoding = "ISO-8859-1" if narrow else feed.encoding
    options = {"header": feed.header, "sep": feed.delimiter, "encoding": encoding, "inferSchema": False, "mode": "PERMISSIVE"}
    names = spark.read.csv(paths, **options).columns
    schema = T.StructType([*(T.StructField(n, T.StringType()) for n in names), T.StructField(CORRUPT, T.StringType())])
    df = spark.read.schema(schema).csv(paths, columnNameOfCorruptRecord=CORRUPT, **options)
    if not narrow:
        return df
    high = bytes(range(128, 256))
    latin, meant = high.decode("latin-1"), high.decode(feed.encoding, "replace")
    named = lambda n: n.translate(str.maketrans(latin, meant))
    return df.select(*(F.translate(F.col(f"`{c}`"), latin, meant).alias(named(c)) for c in df.columns))


def read_json(spark: SparkSession, feed: Feed, paths: list[str]) -> DataFrame:
    return spark.read.json(paths, multiLine=feed.format == "json")


def read_xlsx(spark: SparkSession, feed: Feed, paths: list[str]) -> DataFrame:
    """One sheet of each workbook of the folders or files, streamed (`workbooks`), with each row's file."""
    files = [r.path.replace("file:/", "file:///", 1) if r.path.startswith("file:/") and not r.path.startswith("file://") else r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(paths).select("path").collect()]
    if not files:
        raise FileNotFoundError(f"no workbook in {paths}")
    return read_workbooks(spark, sorted(files), feed.sheet).drop(SHEET)


READERS = {"csv": read_csv, "json": read_json, "jsonl": read_json, "xlsx": read_xlsx}


def dated_paths(spark: SparkSession, root: str, watermark: str | None) -> list[str]:
    """Folders `yyyy-mm-dd` under the root that come after the watermark, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(s.getPath().getName() for s in found if s.isDirectory())
    return [f"{root}/{n}" for n in names if not watermark or n > watermark[:10]]


def _time(c):
    """Formats are mixed, so marks are compared as times."""
    return F.coalesce(parse_timestamp(c), parse_date(c).cast("timestamp"))


def read_feed(spark: SparkSession, feed: Feed, watermark: str | None = None) -> DataFrame | None:
    """The feed's new rows with audit input; None where no folder is new. ValueError for an unknown format."""
    if feed.format not in READERS:
        raise ValueError(f"unknown format {feed.format!r}")
    paths = dated_paths(spark, feed.path, watermark) if feed.dated_folders else [feed.path]
    if not paths:
        return None
    df = READERS[feed.format](spark, feed, paths)
    if watermark and feed.watermark_column and not feed.dated_folders:
        df = df.where(_time(F.col(feed.watermark_column)) > _time(F.lit(watermark)))
    return df


def with_audit(df: DataFrame, feed: Feed, batch_id: str) -> DataFrame:
    """Ingest time, system, file, batch, and a hash of the business columns."""
    business = [c for c in df.columns if not c.startswith("_")]
    source = F.col(FILE) if FILE in df.columns else F.col("_metadata.file_path")
    return df.withColumns({"_ingest_ts": F.current_timestamp(), "_source_system": F.lit(feed.system), "_source_file": source, "_batch_id": F.lit(batch_id), "_row_hash": row_hash(business)})


def new_watermark(old: str | None, new: str | None) -> str | None:
    """Moves forward only."""
    return new if new and (not old or new > old) else old


def read_answer_key(spark: SparkSession, path: str, ids: list[str]) -> DataFrame:
    """An answer key as delimited text with a header, every column as text. Rows without one of `ids` are no answer."""
    rows = spark.read.option("header", True).csv(path)
    for c in ids:
        rows = rows.where(F.coalesce(F.trim(F.col(c)), F.lit("")) != "")
    return rows
