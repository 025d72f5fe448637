"""Data-quality rules as data: each names offending rows; outcomes, quarantine and reconciliation follow."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeforge.functions import cleaning as C


@dataclass(frozen=True)
class Rule:
    code: str
    target: str
    severity: str
    violations: Callable[[dict[str, DataFrame]], DataFrame]  # business_key, detail
    max_rate: float = 0.15


def run_rules(tables: dict[str, DataFrame], rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(results, violations). A rate above a rule's limit makes it SUSPECT; counts are one job for all rules."""
    found, totals = [], []
    for rule in rules:
        hits = rule.violations(tables).select(F.col("business_key").cast("string"), F.col("detail").cast("string"))
        found.append(hits.withColumns({"rule_code": F.lit(rule.code), "target": F.lit(rule.target), "severity": F.lit(rule.severity)}))
        totals.append(tables[rule.target].agg(F.count("*").alias("rows_evaluated")).withColumns({"rule_code": F.lit(rule.code), "target": F.lit(rule.target), "severity": F.lit(rule.severity), "max_rate": F.lit(rule.max_rate)}))
    violations = reduce(DataFrame.unionByName, found)
    counts = violations.groupBy("rule_code", "target").agg(F.count("*").alias("rows_violated"))
    rate = F.when(F.col("rows_evaluated") > 0, F.col("rows_violated") / F.col("rows_evaluated")).otherwise(0.0)
    results = reduce(DataFrame.unionByName, totals).join(counts, ["rule_code", "target"], "left").fillna(0, ["rows_violated"]).withColumn("violation_rate", rate)
    status = F.when(F.col("rows_violated") == 0, "PASSED").when(F.col("violation_rate") > F.col("max_rate"), "SUSPECT").otherwise("FAILED")
    return results.withColumn("status", status).drop("max_rate"), violations


def quarantine(df: DataFrame, key: str, violations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean, quarantined): rows with a critical violation leave, with all their rule codes in one text."""
    reasons = violations.where("severity = 'critical'").groupBy("business_key").agg(F.concat_ws(", ", F.array_sort(F.collect_set("rule_code"))).alias("quarantine_reason"))
    on = df[key].cast("string") == reasons["business_key"]
    return df.join(reasons, on, "left_anti"), df.join(reasons, on).drop("business_key")


def rollbacks(df: DataFrame, entity: str, order: str, value: str) -> DataFrame:
    """Readings that are lower than the entity's one before."""
    before = F.lag(value).over(Window.partitionBy(entity).orderBy(order))
    return df.withColumn("previous", before).where(F.col(value) < F.col("previous"))


def sequence_breaks(df: DataFrame, stages: list[str]) -> DataFrame:
    """Rows where any later stage lies before an earlier one."""
    pairs = [F.col(b) < F.col(a) for i, a in enumerate(stages) for b in stages[i + 1 :]]
    return df.where(reduce(lambda x, y: x | y, (F.coalesce(p, F.lit(False)) for p in pairs)))


def orphans(df: DataFrame, key: str, master: DataFrame, master_key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).join(master.select(F.col(master_key).alias(key)).distinct(), key, "left_anti")


def with_previous_rate(batches: DataFrame, batch: str, rate: str) -> DataFrame:
    """Each batch's rate next to that of the batch before. `batches` has one row a batch, so one task orders them."""
    return batches.withColumn(f"{rate}_before", F.lag(rate).over(Window.orderBy(batch)))


def vin_by_places(df: DataFrame, keys: list[str], vin: str) -> DataFrame:
    """Check digits by a row a place, joined with the values of signs and the weights of places: expected and actual digit, and whether they are equal.

    A second way to `cleaning.vin_check_digit`, which is one expression. Numbers that haven't 17 signs with a value are
    left out. Both tables are fixed and small: 33 signs, 17 places.
    """
    spark = df.sparkSession
    signs = spark.createDataFrame([*zip(C.VIN_FROM, map(int, C.VIN_TO), strict=True), *((str(n), n) for n in range(10) if str(n) not in C.VIN_FROM)], "_sign string, _value int")
    weights = spark.createDataFrame([*enumerate(C.VIN_WEIGHTS, 1)], "_place int, _weight int")
    text = F.upper(F.trim(vin))
    rows = df.where((F.length(text) == 17) & ~text.rlike("[IOQ]")).select(*keys, text.alias("_vin"), F.explode(F.sequence(F.lit(1), F.lit(17))).alias("_place"))
    signed = rows.withColumn("_sign", F.expr("substring(_vin, _place, 1)")).join(F.broadcast(weights), "_place").join(F.broadcast(signs), "_sign")
    left = signed.groupBy(*keys, "_vin").agg(F.sum(F.col("_value") * F.col("_weight")).alias("_sum"), F.count("*").alias("_n")).where("_n % 17 = 0")
    left = left.withColumn("_left", F.expr("(_sum div (_n div 17)) % 11"))  # repeated rows count once
    expected = F.when(F.col("_left") == 10, "X").otherwise(F.col("_left").cast("string"))
    actual = F.substring("_vin", 9, 1)
    return left.select(*keys, F.col("_vin").alias("vin"), actual.alias("actual_check_digit"), expected.alias("expected_check_digit"), (actual == expected).cast("int").alias("is_valid"))


def vin_differences(df: DataFrame, keys: list[str], vin: str, valid: str) -> DataFrame:
    """Rows whose flag `valid` is another than the check by places says, either way unknown included."""
    other = vin_by_places(df, keys, vin).select(*keys, "expected_check_digit", F.col("is_valid").alias("_by_places"))
    both = df.select(*keys, vin, valid).join(other, keys, "left")
    return both.where(~F.col(valid).eqNullSafe(F.col("_by_places"))).select(*keys, F.col(vin).alias("vin"), F.col(valid).alias("stated"), F.col("_by_places").alias("by_places"), "expected_check_digit")


def detection(injected: DataFrame, detected: DataFrame) -> DataFrame:
    """By rule: injected defects, those detected, recall, and detections without an injection. Both: rule_code, business_key."""
    both = injected.select("rule_code", "business_key", F.lit(True).alias("i")).distinct().join(detected.select("rule_code", "business_key", F.lit(True).alias("d")).distinct(), ["rule_code", "business_key"], "full_outer")
    n = both.groupBy("rule_code").agg(F.count("i").alias("injected"), F.count_if(F.col("i") & F.col("d")).alias("detected"), F.count_if(F.col("i").isNull()).alias("without_injection"))
    return n.withColumn("recall", F.try_divide("detected", "injected"))


def reconcile(log: DataFrame) -> DataFrame:
    """By batch: steps, rows read and written, and a status. `log`: batch_id, step, status, rows_read, rows_written.

    A batch with a failed step is FAILED, one with a step that has not ended RUNNING, else SUCCEEDED.
    """
    status = F.when(F.count_if(F.col("status") == "FAILED") > 0, "FAILED").when(F.count_if(F.col("status") == "RUNNING") > 0, "RUNNING").otherwise("SUCCEEDED")
    return log.groupBy("batch_id").agg(F.count("*").alias("steps"), F.sum("rows_read").alias("rows_read"), F.sum("rows_written").alias("rows_written"), status.alias("status"))
