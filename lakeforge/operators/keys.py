"""Latest rows, upserts, interval joins and series: the relational building blocks of the silver and gold layers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPEN_END = "9999-12-31"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one is set only for local sessions without."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Written once to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Written once to the shared folder as a table, which later plans read by columns."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows, of some hundred bytes each, that one task sorts: a few of them fit into a share of an executor's memory.
TASK_ROWS = 200_000


def dealt(df: DataFrame, *keys: str | Column, rows: int | None = None) -> DataFrame:
    """Rows dealt out by keys to as many tasks as their number needs, so that sorts behind it stay in memory.

    The session's number of shuffle partitions is fixed, and tasks of a large table would spill all their rows. `rows`:
    their number, where it is known; else they are counted, which for Parquet reads no column.
    """
    n = df.count() if rows is None else rows
    few = min(df.sparkSession.sparkContext.defaultParallelism, n // 20_000 + 1)
    return df.repartition(max(few, n // TASK_ROWS + 1), *keys)


#: Keys that are sent to all tasks, at most.
FEW_KEYS = 100_000


def among(df: DataFrame, found: DataFrame, column: str, rows: int | None = None) -> DataFrame:
    """Rows whose value is one of the distinct values of `found`, a table of that column alone. Few values go to all tasks; only for many the rows are shuffled, and none are sorted."""
    held = stored(found)
    if held.count() <= FEW_KEYS:
        return df.join(F.broadcast(held), column, "left_semi")
    return dealt(df, column, rows=rows).join(held.hint("shuffle_hash"), column, "left_semi")


def latest_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in `order`. A window group limit drops the rest before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def classify_changes(target: DataFrame, source: DataFrame, keys: list[str], hash_col: str = "_row_hash") -> DataFrame:
    """keys and action: insert, update, unchanged or missing (in the target alone)."""
    t = target.select(*keys, F.col(hash_col).alias("_t"), F.lit(True).alias("_in_t"))
    s = source.select(*keys, F.col(hash_col).alias("_s"), F.lit(True).alias("_in_s"))
    action = F.when(F.col("_in_t").isNull(), "insert").when(F.col("_in_s").isNull(), "missing").when(F.col("_t").eqNullSafe(F.col("_s")), "unchanged").otherwise("update")
    return t.join(s, keys, "full_outer").select(*keys, action.alias("action"))


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The target with the source's rows in place of those with their keys."""
    return target.join(source.select(*keys).distinct(), keys, "left_anti").unionByName(source, allowMissingColumns=True)


def intervals(df: DataFrame, keys: list[str], start: str, valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    """Half-open intervals from each row's start to the key's next; the last stays open."""
    following = F.lead(start).over(Window.partitionBy(*keys).orderBy(start))
    return df.withColumn(valid_to, F.coalesce(following, F.lit(OPEN_END).cast("date"))).withColumnRenamed(start, valid_from)


def temporal_join(fact: DataFrame, dim: DataFrame, fact_key: str, fact_date: str, dim_key: str, columns: list[str], how: str = "left") -> DataFrame:
    """The version that held on the fact's date; the natural key stays an equi key, so the join is never nested-loop."""
    d = dim.select(F.col(dim_key).alias("_k"), F.col("valid_from").alias("_f"), F.col("valid_to").alias("_t"), *columns)
    on = (fact[fact_key] == d["_k"]) & (fact[fact_date] >= d["_f"]) & (fact[fact_date] < d["_t"])
    return fact.join(d, on, how).drop("_k", "_f", "_t")


def with_rate(df: DataFrame, rates: DataFrame, currency: str, on: str, base: str, out: str) -> DataFrame:
    """Forward-filled rates (currency, fx_date, rate): each holds until the next; base is 1; before a currency's first rate there is none."""
    r = intervals(rates.select(F.col("currency").alias("_currency"), "fx_date", "rate"), ["_currency"], "fx_date").withColumnRenamed("rate", "_rate")
    joined = temporal_join(df, r, currency, on, "_currency", ["_rate"])
    return joined.withColumn(out, F.when(F.col(currency) == base, F.lit(1)).otherwise(F.col("_rate")).cast("decimal(18,6)")).drop("_rate")


def to_base_currency(df: DataFrame, rates: DataFrame, amount: str, currency: str, on: str, base: str, out: str) -> DataFrame:
    """An amount at the rate of its day, in hundredths."""
    return with_rate(df, rates, currency, on, base, "_fx").withColumn(out, (F.col(amount) * F.col("_fx")).cast("decimal(18,2)")).drop("_fx")


def expand_days(df: DataFrame, start: str, end: str, out: str) -> DataFrame:
    """One row for each day of [start, end): a generator in place of a range join with a calendar."""
    last = F.date_sub(F.col(end), 1)
    return df.where(F.col(start) < F.col(end)).withColumn(out, F.explode(F.sequence(F.col(start), last)))


def lookup_as_of(fact: DataFrame, dim: DataFrame, sk: str, key: str, on: str, date: str, out: str | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """The surrogate key of the version that held on the fact's date, -1 where there is none, and `columns` of it.

    Special members have no period of their own.
    """
    d = dim.where(F.col(sk) > 0).select(F.col(key).alias("_k"), F.col("valid_from").alias("_f"), F.col("valid_to").alias("_t"), F.col(sk).alias("_sk"), *columns)
    match = (fact[on] == d["_k"]) & (fact[date] >= d["_f"]) & (fact[date] < d["_t"])
    return fact.join(d, match, "left").withColumn(out or sk, F.coalesce("_sk", F.lit(-1))).drop("_k", "_f", "_t", "_sk")


def lookup_by_day(fact: DataFrame, dim: DataFrame, sk: str, key: str, on: str, date: str, days: DataFrame) -> DataFrame:
    """`lookup_as_of` for a dimension of which facts name few members: each key and day is looked up once and sent to the facts, which stay where they are.

    `days`: a table with all keys and days of the facts. Where members times days are many, facts are shuffled as ever.
    """
    found = stored(lookup_as_of(days.select(on, date).distinct(), dim, sk, key, on, date, "_found").where("_found > 0"))
    if found.count() > FEW_KEYS:
        return lookup_as_of(fact, dim, sk, key, on, date)
    k = found.select(F.col(on).alias("_k"), F.col(date).alias("_d"), "_found")
    joined = fact.join(F.broadcast(k), (fact[on] == k["_k"]) & (fact[date] == k["_d"]), "left")
    return joined.withColumn(sk, F.coalesce("_found", F.lit(-1))).drop("_k", "_d", "_found")


def date_key_or_unknown(date: Column, first: str, last: str) -> Column:
    """The key of the calendar's day, -1 outside the calendar: a join with the date dimension whose keys are computed."""
    return F.when(date.between(F.lit(first).cast("date"), F.lit(last).cast("date")), F.year(date) * 10_000 + F.month(date) * 100 + F.day(date)).otherwise(-1)


def lookup(fact: DataFrame, dim: DataFrame, on: Column, sk: str, out: str, missing: int = -1) -> DataFrame:
    """A dimension's key, or the unknown member."""
    return fact.join(dim, on, "left").withColumn(out, F.coalesce(F.col(sk), F.lit(missing)))
