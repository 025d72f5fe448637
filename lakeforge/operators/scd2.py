"""Slowly changing dimensions as functions from versions and snapshots to versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeforge.functions.cleaning import row_hash
from lakeforge.operators.keys import OPEN_END, checkpoint, latest_by_key

# The attributes whose change starts a version, by dimension.
TRACKED = {
    "dealer": ("dealer_name", "dealer_type", "province_code", "city", "region", "address_line", "phone", "workshop_bay_count", "monthly_capacity_hours", "is_active"),
    "employee": ("full_name", "dealer_code", "role_code", "email", "is_active"),
    "model_trim": ("brand", "model_name", "trim_name", "model_year", "list_price_try", "warranty_months", "is_active"),
    "part": ("part_name", "part_group_code", "is_genuine", "supplier_id", "list_price_try", "is_active"),
    "vehicle": ("status", "stock_dealer_code", "plate_number", "master_customer_id", "dealer_cost_try"),
}


def changed_attributes(versions: DataFrame, key: str, tracked: Sequence[str], start: str = "valid_from", out: str = "changed") -> DataFrame:
    """With the names of the tracked attributes, in their order, that differ from the key's version before; null for its first."""
    by = Window.partitionBy(key).orderBy(start)
    names = F.array_compact(F.array(*(F.when(~F.lag(c).over(by).eqNullSafe(F.col(c)), F.lit(c)) for c in tracked)))
    return versions.withColumn(out, F.when(F.row_number().over(by) > 1, names))


def backfill(snapshots: DataFrame, key: str, tracked: list[str], observed: str, ingested: str) -> DataFrame:
    """Versions from all snapshots: one a key and day, only where a tracked value changed; numbered by key and day."""
    day = snapshots.where(F.trim(F.col(key).cast("string")) != "").withColumn("_day", F.to_date(observed))
    day = latest_by_key(day, [key, "_day"], [F.col(ingested).desc_nulls_last()]).withColumn("_row_hash", row_hash(tracked))
    by = Window.partitionBy(key).orderBy("_day")
    before = F.lag("_row_hash").over(by)
    kept = day.withColumn("_before", before).where("_before is null or _before <> _row_hash")
    following = F.lead("_day").over(by)
    return kept.select(key, *tracked, "_row_hash", F.col("_day").alias("valid_from"), F.coalesce(following, F.lit(OPEN_END).cast("date")).alias("valid_to"), following.isNull().alias("is_current"), F.lit(False).alias("is_inferred"))


def with_surrogate(df: DataFrame, order: list[str], sk: str, start: int = 0) -> DataFrame:
    """Keys from start + 1 in order, without gaps or repeats.

    Ranges are numbered on their own and offset by the counts before them. A second evaluation would draw other
    range bounds, so the numbered ranges are written once, and both the counts and the rows come from there.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    parts = checkpoint(parts)
    first = parts.groupBy("_p").agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    base = first.withColumn("_base", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))  # one row a partition
    return parts.join(F.broadcast(base.select("_p", "_first", "_base")), "_p").withColumn(sk, F.col("_i") - F.col("_first") + 1 + F.coalesce("_base", F.lit(0)) + start).drop("_p", "_i", "_first", "_base")


def special_members(dim: DataFrame, sk: str, key: str, members: tuple[tuple[int, str], ...] = ((-1, "-1"), (-2, "-2")), **values) -> DataFrame:
    """The dimension with its unknown (-1) and not applicable (-2) member, open for ever; other columns are null unless given."""
    spark = dim.sparkSession
    rows = spark.createDataFrame(list(members), "s long, k string")
    fixed = {sk: F.col("s"), key: F.col("k"), "valid_from": F.lit("1900-01-01"), "valid_to": F.lit(OPEN_END), "is_current": F.lit(True), "is_inferred": F.lit(False)} | {c: F.lit(v) for c, v in values.items()}
    return dim.unionByName(rows.select(*(fixed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in dim.schema)))


def load_dimension(snapshots: DataFrame, key: str, tracked: list[str], observed: str, ingested: str, sk: str, existing: DataFrame | None = None, specials: tuple = ((-1, "-1"), (-2, "-2"))) -> DataFrame:
    """Backfill with surrogate keys by key and day, and special members. A dimension that holds real members already is left as it is."""
    if existing is not None and not existing.where(F.col(sk) > 0).isEmpty():
        return existing
    numbered = with_surrogate(backfill(snapshots, key, tracked, observed, ingested), [key, "valid_from"], sk)
    return special_members(numbered, sk, key, specials) if specials else numbered


def owner_since(versions: DataFrame, entity: str, owner: str, start: str, out: str = "owner_since_date") -> DataFrame:
    """The day from which a version's owner held the entity: the start of the version that changed owner, spread over its later ones."""
    before = F.lag(owner).over(Window.partitionBy(entity).orderBy(start))
    change = versions.withColumn("_change", F.when(~before.eqNullSafe(F.col(owner)), F.col(start)))
    return change.withColumn(out, F.coalesce("_change", F.max("_change").over(Window.partitionBy(entity, owner)))).drop("_change")


def apply_changes(dim: DataFrame, source: DataFrame, key: str, tracked: list[str], effective: str, deactivate: str | None = None, since: str | None = None, sk: str | None = None) -> DataFrame:
    """New keys start a version, changed ones close theirs and start one, others stay.

    An inferred member whose key the source now has is filled in place: its version, dates and surrogate key stay, its
    values become the source's. With `deactivate`, current versions of keys that the source lacks get 0 there, without
    a new version. With `since`, a column of the source, a new key's version starts then, if known. With `sk`, new
    versions get the next surrogate keys.
    """
    when = F.lit(effective).cast("date")
    extra = [since] if since else []
    new = source.select(key, *dict.fromkeys([*tracked, *extra])).withColumn("_row_hash", row_hash(tracked))
    s = new.select(F.col(key).alias("_k"), F.col("_row_hash").alias("_h"), *(F.col(c).alias(f"_new_{c}") for c in tracked), F.lit(True).alias("_seen"))
    joined = dim.join(s, dim[key] == s["_k"], "left")
    here = F.col("is_current") & F.col("_seen").isNotNull()
    promoted = F.coalesce(here & F.col("is_inferred"), F.lit(False))
    changed = F.coalesce(here & ~F.col("is_inferred") & ~F.col("_row_hash").eqNullSafe(F.col("_h")), F.lit(False))
    closed = joined.withColumns({"_c": changed, "_f": promoted})
    closed = closed.withColumns({c: F.when(F.col("_f"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in tracked} | {
        "_row_hash": F.when(F.col("_f"), F.col("_h")).otherwise(F.col("_row_hash")), "is_inferred": F.col("is_inferred") & ~F.col("_f"),
        "valid_to": F.when(F.col("_c"), when).otherwise(F.col("valid_to")), "is_current": F.col("is_current") & ~F.col("_c"),
    })
    if deactivate:
        closed = closed.withColumn(deactivate, F.when(F.col("is_current") & F.col("_seen").isNull(), 0).otherwise(F.col(deactivate)))
    current = dim.where("is_current").select(F.col(key).alias("_k"), F.col("_row_hash").alias("_h"), F.col("is_inferred").alias("_i"))
    known = dim.select(F.col(key).alias("_k")).distinct().withColumn("_known", F.lit(True))
    fresh = new.join(current, (F.col(key) == F.col("_k")) & (F.col("_row_hash").eqNullSafe(F.col("_h")) | F.col("_i")), "left_anti")
    fresh = fresh.join(known, F.col(key) == F.col("_k"), "left") if since else fresh
    start = F.when(F.col("_known").isNull() & F.col(since).isNotNull(), F.col(since)).otherwise(when) if since else when
    fresh = fresh.withColumns({"valid_from": start, "valid_to": F.lit(OPEN_END).cast("date"), "is_current": F.lit(True), "is_inferred": F.lit(False)})
    fresh = fresh.drop("_k", "_known", *(c for c in extra if c not in dim.columns))
    if sk:
        last = dim.agg(F.coalesce(F.max(sk), F.lit(0)).alias("_last"))
        fresh = with_surrogate(fresh, [key], sk).crossJoin(F.broadcast(last)).withColumn(sk, F.col(sk) + F.col("_last")).drop("_last")  # one row
    return closed.drop("_k", "_h", "_seen", "_c", "_f", *(f"_new_{c}" for c in tracked)).unionByName(fresh, allowMissingColumns=True)


def type1(dim: DataFrame, source: DataFrame, key: str, sk: str) -> DataFrame:
    """The source's values for its keys, under the surrogate keys they have; new ones get the next. Others stay as they are."""
    keys = dim.select(key, sk)
    old = source.join(keys, key)
    last = dim.agg(F.coalesce(F.max(sk), F.lit(0)).alias("_last"))
    new = with_surrogate(source.join(keys, key, "left_anti"), [key], sk).crossJoin(F.broadcast(last))  # one row
    new = new.withColumn(sk, F.col(sk) + F.col("_last")).drop("_last")
    return old.unionByName(new).unionByName(dim.join(source.select(key), key, "left_anti"), allowMissingColumns=True)


def integrity(dim: DataFrame, key: str) -> DataFrame:
    """Broken keys: overlap or gap between neighbouring versions, or not exactly one current."""
    by = Window.partitionBy(key).orderBy("valid_from")
    v = dim.withColumn("_next", F.lead("valid_from").over(by))
    per = v.groupBy(key).agg(F.count_if(F.col("_next") < F.col("valid_to")).alias("overlaps"), F.count_if(F.col("_next") > F.col("valid_to")).alias("gaps"), F.count_if("is_current").alias("current_rows"))
    return per.where("overlaps > 0 or gaps > 0 or current_rows <> 1")


def inferred_members(references: list[DataFrame], dim: DataFrame, key: str, status: str = "UNKNOWN") -> DataFrame:
    """Keys that facts name but the dimension lacks, from the day they were first seen. Each reference: key, seen."""
    seen = references[0]
    for other in references[1:]:
        seen = seen.unionByName(other)
    first = seen.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("seen").alias("valid_from"))
    return first.join(dim.select(key).distinct(), key, "left_anti").withColumns({"valid_to": F.lit(OPEN_END).cast("date"), "is_current": F.lit(True), "is_inferred": F.lit(True), "_row_hash": F.lit(None).cast("string"), "status": F.lit(status)})


def junk_dimension(flags: list[DataFrame], columns: list[str]) -> DataFrame:
    """Distinct combinations over all facts, with a readable description."""
    rows = flags[0].select(*columns)
    for other in flags[1:]:
        rows = rows.unionByName(other.select(*columns))
    return rows.distinct().withColumn("description", F.concat_ws(", ", *(F.when(F.col(c).cast("string") == "1", F.lit(c)) for c in columns)))


def numbered_junk(dim: DataFrame, columns: list[str], sk: str, unknown: dict) -> DataFrame:
    """A junk dimension with keys in the order of its attributes and the member -1, whose attributes a real row may have as well."""
    out = with_surrogate(dim, columns, sk)
    row = out.sparkSession.range(1).select(*(F.lit(-1 if f.name == sk else unknown.get(f.name)).cast(f.dataType).alias(f.name) for f in out.schema))
    return out.unionByName(row)


def with_inferred(dim: DataFrame, references: list[DataFrame], key: str, sk: str, status: str = "UNKNOWN") -> DataFrame:
    """The dimension with members for keys that facts name and it lacks, under the next surrogate keys in the order of the keys.

    To be called before the facts look their keys up: a member holds from the first day that names it, so every fact
    that does so finds it. `references`: key, seen. Columns that the inferred members lack are null.
    """
    last = dim.agg(F.greatest(F.coalesce(F.max(sk), F.lit(0)), F.lit(0)).alias("_last"))
    new = with_surrogate(inferred_members(references, dim, key, status), [key], sk).crossJoin(F.broadcast(last))  # one row
    return dim.unionByName(new.withColumn(sk, F.col(sk) + F.col("_last")).drop("_last"), allowMissingColumns=True)
