"""Versions of the dimensions by their whole sets of tracked attributes, with what changed in each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeforge.functions import cleaning as C
from lakeforge.operators import scd2, silver
from lakeforge.plans.entities import _with, raw
from lakeforge.plans.registry import query

#: Feed of each dimension.
FEED = {"dealer": "dealer", "employee": "employee", "model_trim": "model", "part": "part", "vehicle": "vehicle"}

_INT, _COMMA, _POINT = "try_cast({} AS INT)", "replace(replace({}, '.', ''), ',', '.')::DECIMAL(18,2)", "{}::DECIMAL(18,2)"
_TYPES = {
    "dealer": {"workshop_bay_count": _INT, "monthly_capacity_hours": _INT, "is_active": _INT},
    "employee": {"is_active": _INT},
    "model_trim": {"model_year": _INT, "list_price_try": _COMMA, "warranty_months": "NULL::INT", "is_active": _INT},
    "part": {"is_genuine": _INT, "list_price_try": _POINT, "is_active": _INT},
    "vehicle": {"dealer_cost_try": _COMMA},
}


def _sql(name: str) -> str:
    key, source = silver.MASTERS[name].keys[0], f"raw_{FEED[name]}"
    if name == "vehicle":
        key, source = "upper(vin)", f"(SELECT r.*, x.master_customer_id FROM {source} r LEFT JOIN raw_xref x ON x.customer_id = r.owner_customer_id)"
    tracked = scd2.TRACKED[name]
    text = "nullif(trim({}), '')"
    typed = ", ".join(f"{_TYPES[name].get(c, text).format(c)} AS {c}" for c in tracked)
    differ = ", ".join(f"CASE WHEN {c} IS DISTINCT FROM lag({c}) OVER w THEN '{c}' END" for c in tracked)
    return f"""SELECT '{name}' AS dimension, k AS business_key, day AS valid_from, coalesce(lead(day) OVER (PARTITION BY k ORDER BY day), DATE '9999-12-31') AS valid_to, CASE WHEN n > 1 THEN changes END AS changed
 FROM (SELECT k, day, row_number() OVER w AS n, concat_ws(',', {differ}) AS changes FROM (SELECT {key} AS k, last_modified_ts::TIMESTAMP::DATE AS day, {typed} FROM {source}
 QUALIFY row_number() OVER (PARTITION BY k, day ORDER BY _ingest_ts DESC) = 1) WINDOW w AS (PARTITION BY k ORDER BY day)) WHERE n = 1 OR changes <> ''"""


def _versions(spark, d: str, name: str) -> DataFrame:
    spec, tracked = silver.MASTERS[name], list(scd2.TRACKED[name])
    rows, key = raw(spark, d, FEED[name]), spec.keys[0]
    if name == "vehicle":
        owners = raw(spark, d, "xref").select(F.col("customer_id").alias("owner_customer_id"), "master_customer_id")
        rows = rows.join(owners, "owner_customer_id", "left")
    snapshots = rows.select(*(e.alias(c) for c, e in silver.typed(rows, spec, [key, *tracked]).items()), C.parse_timestamp(F.col("last_modified_ts")).alias("observed"), "_ingest_ts")
    versions = scd2.changed_attributes(scd2.backfill(snapshots, key, tracked, "observed", "_ingest_ts"), key, tracked)
    return versions.select(F.lit(name).alias("dimension"), F.col(key).alias("business_key"), "valid_from", "valid_to", F.array_join("changed", ",").alias("changed"))


@query(_with(" UNION ALL ".join(_sql(name) for name in FEED)))
def tracked_versions(spark, d):
    """Every version of the five dimensions, and the tracked attributes that started it."""
    return reduce(DataFrame.unionByName, (_versions(spark, d, name) for name in FEED))
