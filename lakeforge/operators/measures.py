"""Measures with time intelligence, semi-additive logic, retention, and row security."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_prior_year(df: DataFrame, month: str, keys: list[str], value: str) -> DataFrame:
    """Each month's value next to that of the same month a year before; `month` is the first of the month."""
    prior = df.select(*keys, F.add_months(month, 12).alias(month), F.col(value).alias(f"{value}_ly"))
    return df.join(prior, [*keys, month], "left").withColumn("yoy", F.try_divide(F.col(value) - F.col(f"{value}_ly"), f"{value}_ly"))


def at_period_end(df: DataFrame, date: str, period: Column, measures: list[Column]) -> DataFrame:
    """Semi-additive measures: only the last date of each period that has rows counts."""
    p = df.withColumn("period", period)
    last = p.groupBy("period").agg(F.max(date).alias("_last"))
    return p.join(last, "period").where(F.col(date) == F.col("_last")).groupBy("period").agg(*measures)


def retention(base: DataFrame, later: DataFrame, key: str) -> DataFrame:
    """How many of the base's keys come again, as a set intersection."""
    b, l = base.select(key).distinct(), later.select(key).distinct()
    kept = b.join(l, key, "left_semi").agg(F.count("*").alias("retained"))
    return b.agg(F.count("*").alias("base")).crossJoin(kept).withColumn("rate", F.try_divide("retained", "base"))  # two single rows


def visible(dim: DataFrame, grants: DataFrame, user: str, key: str, region: str) -> DataFrame:
    """Rows that a user's active grants open: everything, a region, or one key. No grant, no row."""
    mine = grants.where((F.col("user") == user) & F.col("active"))
    on = (mine["scope"] == "ALL") | ((mine["scope"] == "REGION") & (mine["value"] == dim[region].cast("string"))) | ((mine["scope"] == "KEY") & (mine["value"] == dim[key].cast("string")))
    return dim.join(F.broadcast(mine), on, "left_semi")  # a user's grants: a handful of rows


def date_dimension(spark, start: str, end: str, holidays: DataFrame) -> DataFrame:
    """One row a day: keys, ISO week, quarter, the same day a year before, and working days (half days count)."""
    d = F.col("date")
    days = spark.sql(f"select explode(sequence(date'{start}', date'{end}')) as date")
    marks = holidays.groupBy(F.col("date")).agg(F.max("full_day").alias("full_day"))
    out = days.join(F.broadcast(marks), "date", "left")  # holidays: a few a year
    return out.select(
        "date", F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"), F.date_format(d, "yyyyMM").cast("int").alias("month_key"), F.weekofyear(d).alias("iso_week"),
        F.extract(F.lit("YEAROFWEEK"), d).cast("int").alias("iso_year"), (F.weekday(d) + 1).alias("iso_day"), F.quarter(d).alias("quarter"), F.last_day(d).alias("month_end"),
        F.date_format(F.add_months(d, -12), "yyyyMMdd").cast("int").alias("ly_date_key"),
        ((F.weekday(d) < 5) & ~F.coalesce(F.col("full_day"), F.lit(False))).cast("int").alias("is_working_day"),
    )


def with_unknown_date(dates: DataFrame) -> DataFrame:
    """The calendar with its member -1, in month 0: facts whose date is not known or lies outside point to it."""
    fixed = {"date": F.lit("1900-01-01"), "date_key": F.lit(-1), "ly_date_key": F.lit(None), "month_end": F.lit("1900-01-01")}
    row = dates.sparkSession.range(1).select(*(fixed.get(f.name, F.lit(0)).cast(f.dataType).alias(f.name) for f in dates.schema))
    return dates.unionByName(row)


def _share(top: Column, bottom: Column) -> Column:
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def sale_measures(sales: DataFrame, by: list[str]) -> DataFrame:
    """Sums, weighted rates, days in stock of new vehicles alone, trade-ins, and days from order to delivery."""
    net, listed, discount, margin = (F.sum(c) for c in ("net_sale_amount", "list_price", "discount_amount", "vehicle_margin_amount"))
    trade_ins = F.count_if(F.col("trade_in_vehicle_sk") > 0)
    return sales.groupBy(*by).agg(
        F.count("*").alias("sale_count"), net.alias("net_sale"), listed.alias("list_price"), discount.alias("discount"), margin.alias("gross_margin"),
        _share(discount, listed).alias("discount_rate"), _share(margin, net).alias("gross_margin_rate"), _share(net, F.count("*")).alias("average_selling_price"),
        F.avg(F.when(F.col("sale_type") == "NEW", F.col("days_in_stock"))).alias("average_days_in_stock"), trade_ins.alias("trade_in_count"),
        _share(trade_ins, F.count("*")).alias("trade_in_rate"), F.avg("order_to_delivery_days").alias("average_order_to_delivery"),
    )


def service_measures(orders: DataFrame, by: list[str]) -> DataFrame:
    """Revenue, hours (missing ones don't count), the share of waiting for parts, open orders, and serviced vehicles."""
    revenue, wait, cycle = F.sum("total_amount"), F.sum("parts_wait_hours"), F.sum("total_cycle_hours")
    vehicles = F.count_distinct(F.when(F.col("vehicle_sk") > 0, F.col("vin")))
    return orders.groupBy(*by).agg(
        F.count("*").alias("repair_order_count"), F.sum("total_labour_amount").alias("labour_revenue"), F.sum("total_part_amount").alias("part_revenue"), revenue.alias("service_revenue"),
        F.sum("customer_payable_amount").alias("customer_payable"), F.sum("total_warranty_amount").alias("warranty"), F.avg("total_cycle_hours").cast("double").alias("avg_cycle_hours"),
        F.avg("touch_time_hours").cast("double").alias("avg_touch_hours"), F.avg("parts_wait_hours").cast("double").alias("avg_parts_wait_hours"), _share(wait, cycle).alias("parts_wait_share"),
        F.count_if(F.col("status") == "WAITING_PARTS").alias("orders_awaiting_parts"), F.sum("is_open").alias("open_orders"), vehicles.alias("serviced_vehicles"), _share(revenue, vehicles).alias("revenue_per_vehicle"),
    )


def warranty_cost_ratio(orders: DataFrame, sales: DataFrame, by: list[str]) -> DataFrame:
    """Warranty cost over net sales at a common grain, whatever filter the sales are under."""
    cost = orders.groupBy(*by).agg(F.sum("total_warranty_amount").alias("warranty"))
    net = sales.groupBy(*by).agg(F.sum("net_sale_amount").alias("net_sale"))
    return cost.join(net, by, "left").withColumn("warranty_cost_ratio", _share(F.col("warranty"), F.col("net_sale")))


def claim_measures(claims: DataFrame, by: list[str]) -> DataFrame:
    claimed, approved = F.sum("claimed_amount"), F.sum("approved_amount")
    return claims.groupBy(*by).agg(F.count("*").alias("claims"), claimed.alias("claimed"), approved.alias("approved"), _share(approved, claimed).alias("approval_by_value"), F.sum("unreimbursed_amount").alias("unreimbursed"))


def recall_measures(coverage: DataFrame, by: list[str]) -> DataFrame:
    done = F.sum("is_completed")
    return coverage.groupBy(*by).agg(F.count("*").alias("coverage"), done.alias("completed"), _share(done, F.count("*")).alias("completion_rate"), F.count_if(F.col("is_completed") == 0).alias("outstanding"), F.avg("days_outstanding").alias("avg_days_outstanding"))


def purchase_measures(purchases: DataFrame, by: list[str]) -> DataFrame:
    """On-time rate over lines whose lateness is known; the delay is signed."""
    ordered, received, late = F.sum("ordered_quantity"), F.sum("received_quantity"), F.sum("is_late")
    return purchases.groupBy(*by).agg(
        F.count("*").alias("po_lines"), F.sum("line_amount").alias("purchase_amount"), ordered.alias("ordered"), received.alias("received"), late.alias("late_lines"),
        (1 - _share(late, F.count("is_late"))).alias("on_time_rate"), F.avg("delay_days").alias("avg_delay_days"), _share(received, ordered).alias("fill_rate"),
    )


def quality_measures(results: DataFrame, by: list[str]) -> DataFrame:
    violated, evaluated = F.sum("rows_violated"), F.sum("rows_evaluated")
    n = lambda cond: F.count_if(cond)
    quarantined = F.sum(F.when(F.col("severity") == "critical", F.col("rows_violated")).otherwise(0))
    return results.groupBy(*by).agg(
        F.count("*").alias("rules_evaluated"), violated.alias("rows_violated"), evaluated.alias("rows_evaluated"), _share(violated, evaluated).alias("violation_rate"),
        n((F.col("severity") == "critical") & (F.col("rows_violated") > 0)).alias("critical_rules"), n(F.col("status").isin("FAILED", "SUSPECT")).alias("failed_rules"),
        n(F.col("status") == "ERROR").alias("errored_rules"), _share(quarantined, evaluated).alias("quarantine_rate"),
    )


def with_activity(dealers: DataFrame, sales: DataFrame, orders: DataFrame, key: str = "dealer_code") -> DataFrame:
    """Each dealer with 1 where it has a sale or an order, else 0."""
    active = sales.select(key).unionByName(orders.select(key)).distinct().withColumn("has_activity", F.lit(1))
    return dealers.join(active, key, "left").withColumn("has_activity", F.coalesce("has_activity", F.lit(0)))


def top(df: DataFrame, n: int, measure: str, *ties: str) -> DataFrame:
    """The n rows with the largest measure, largest first, nulls last; ties in the given order."""
    return df.orderBy(F.col(measure).desc_nulls_last(), *ties).limit(n)
