"""Facts of the star: dates by role, dimension versions as of the fact's date, flags, and the aggregates over them.

`star` maps names to dimensions: vehicle, customer, dealer, employee, model, part (versions with `<name>_sk`, valid_from,
valid_to), supplier, service_type and flag. `calendar` is the first and last day of the date dimension. A key that is
not known is -1, one that doesn't apply -2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeforge.functions import cleaning as C
from lakeforge.operators.keys import date_key_or_unknown, dealt, expand_days, lookup, lookup_as_of, lookup_by_day

Star = dict[str, DataFrame]
Calendar = tuple[str, str]
# The service types and their keys.
SERVICE_TYPES = (
    (1, "MAINT", "Scheduled maintenance", 0, 1, 2.0), (2, "REPAIR", "Fault repair", 0, 0, 3.5), (3, "WARRANTY", "Warranty repair", 1, 0, 4.0), (4, "BODY", "Body and paint", 0, 0, 12.0),
    (5, "TYRE", "Tyre and seasonal", 0, 0, 1.0), (6, "RECALL", "Recall campaign", 1, 0, 1.5), (7, "INSPECT", "Inspection", 0, 0, 1.0), (-1, "-1", "Unknown", 0, 0, 0.0), (-2, "-2", "Not applicable", 0, 0, 0.0),
)
FLAGS = ("is_campaign", "payment_type", "channel", "is_used_vehicle", "is_warranty", "has_trade_in")


def service_types(spark) -> DataFrame:
    """The static dimension."""
    return spark.createDataFrame(list(SERVICE_TYPES), "service_type_sk long, service_type_code string, service_type_name string, is_warranty_eligible int, is_scheduled int, typical_labour_hours double")


def contract_flags(contracts: DataFrame) -> DataFrame:
    """The contract's combination of flags."""
    trade_in = F.coalesce(F.col("trade_in_vin") != "", F.lit(False)).cast("int")
    values = (F.coalesce("is_campaign", F.lit(0)), F.coalesce("payment_type", F.lit("NA")), F.coalesce("channel", F.lit("NA")), F.coalesce(F.col("sale_type") == "USED", F.lit(False)).cast("int"), F.lit(0), trade_in)
    return contracts.withColumns({f"_f_{n}": v for n, v in zip(FLAGS, values, strict=True)})


def order_flags(orders: DataFrame) -> DataFrame:
    values = (F.lit(0), F.lit("NA"), F.lit("NA"), F.lit(0), F.coalesce("is_warranty", F.lit(0)), F.lit(0))
    return orders.withColumns({f"_f_{n}": v for n, v in zip(FLAGS, values, strict=True)})


def _flag(df: DataFrame, flags: DataFrame) -> DataFrame:
    """The junk dimension's key. Its member -1 may have a real row's attributes and takes no part."""
    d = flags.where("flag_sk > 0").select(*(F.col(n).alias(f"_f_{n}") for n in FLAGS), F.col("flag_sk").alias("_flag"))
    return df.join(F.broadcast(d), [f"_f_{n}" for n in FLAGS], "left").withColumn("flag_sk", F.coalesce("_flag", F.lit(-1))).drop("_flag", *(f"_f_{n}" for n in FLAGS))  # combinations of six flags


def _dates(calendar: Calendar, **roles: Column) -> dict[str, Column]:
    return {f"{role}_date_key": date_key_or_unknown(day, *calendar) for role, day in roles.items()}


def with_days(df: DataFrame, calendar: Calendar, **roles: Column) -> DataFrame:
    """With the keys of days, by role, as the facts have them."""
    return df.withColumns(_dates(calendar, **roles))


def sale_keys(contracts: DataFrame, star: Star, customer: str = "master_customer_id", arrivals: DataFrame | None = None) -> DataFrame:
    """Contracts, a table, with the keys of the star's dimensions as of their date, and the vehicle's cost.

    `customer`: the key of that dimension, in both. With `arrivals` (vin, arrival_date) the days in stock, too. Small
    dimensions are met where the rows are; rows are then dealt out by vehicle and by customer, and those with a trade-in by that.
    """
    rows, f = contracts.count(), contracts
    if "flag" in star:
        f = _flag(contract_flags(f), star["flag"])
    if "dealer" in star:
        f = lookup_by_day(f, star["dealer"], "dealer_sk", "dealer_code", "dealer_code", "contract_date", contracts)
    if "employee" in star:
        f = lookup_as_of(f, star["employee"], "employee_sk", "employee_id", "salesperson_id", "contract_date", "salesperson_sk")
    if "model" in star:
        f = lookup_as_of(f, star["model"], "model_sk", "model_trim_code", "model_trim_code", "contract_date")
    f = dealt(f, "vin", rows=rows)
    if arrivals is not None:
        f = f.join(arrivals.select("vin", F.col("arrival_date").alias("_arrival")), "vin", "left")
        f = f.withColumn("days_in_stock", C.days_between(F.col("_arrival"), F.col("delivery_date"))).drop("_arrival")
    f = lookup_as_of(f, star["vehicle"], "vehicle_sk", "vin", "vin", "contract_date", columns=("dealer_cost_amount",))
    if "trade_in_vin" in f.columns:
        traded = dealt(f.where("trade_in_vin <> ''"), "trade_in_vin", rows=rows)
        traded = lookup_as_of(traded, star["vehicle"], "vehicle_sk", "vin", "trade_in_vin", "contract_date", "trade_in_vehicle_sk")
        f = traded.unionByName(f.where("not coalesce(trade_in_vin <> '', false)").withColumn("trade_in_vehicle_sk", F.lit(-2).cast("long")))
    if "customer" in star:
        f = lookup_as_of(dealt(f, customer, rows=rows), star["customer"], "customer_sk", customer, customer, "contract_date")
    return f


def vehicle_sale(contracts: DataFrame, star: Star, calendar: Calendar, customer: str = "master_customer_id", arrivals: DataFrame | None = None) -> DataFrame:
    """One row a contract, as of its date. The margin is over the vehicle's cost, unlike the contract's own. `customer`, `arrivals`: as for `sale_keys`."""
    f = sale_keys(contracts, star, customer, arrivals)
    roles = {r: F.col(f"{r}_date") for r in ("contract", "delivery", "invoice", "registration")}
    return f.withColumns(_dates(calendar, **roles) | {
        "vehicle_margin_amount": (F.col("net_sale_amount") - F.coalesce("dealer_cost_amount", F.lit(0))).cast("decimal(18,2)"),
        "order_to_delivery_days": C.days_between(F.col("contract_date"), F.col("delivery_date")), "sale_count": F.lit(1),
    })


def order_keys(orders: DataFrame, star: Star, customer: str = "master_customer_id", lines: DataFrame | None = None) -> DataFrame:
    """Repair orders, a table, with the keys of the star's dimensions as of check-in, and with `lines` the labour hours that those sold."""
    rows, orders = orders.count(), orders.withColumn("checkin_date", F.to_date("checkin_ts"))
    f = orders
    if lines is not None:
        sold = dealt(lines.where("line_type = 'LABOUR'").select("repair_order_no", "labour_hours"), "repair_order_no", rows=lines.count())
        f = dealt(f, "repair_order_no", rows=rows).join(sold.groupBy("repair_order_no").agg(F.sum("labour_hours").alias("labour_hours_sold")), "repair_order_no", "left")
    if "flag" in star:
        f = _flag(order_flags(f), star["flag"])
    if "dealer" in star:
        f = lookup_by_day(f, star["dealer"], "dealer_sk", "dealer_code", "dealer_code", "checkin_date", orders)
    if "employee" in star:
        for role in ("service_advisor", "technician"):
            f = lookup_as_of(f, star["employee"], "employee_sk", "employee_id", f"{role}_id", "checkin_date", f"{role}_sk")
    if "service_type" in star:
        types = star["service_type"].select(F.col("service_type_code").alias("_code"), F.col("service_type_sk").alias("_sk"))
        f = lookup(f, F.broadcast(types), F.col("service_type_code") == F.col("_code"), "_sk", "service_type_sk").drop("_code", "_sk")  # nine rows
    f = lookup_as_of(dealt(f, "vin", rows=rows), star["vehicle"], "vehicle_sk", "vin", "vin", "checkin_date")
    return lookup_as_of(dealt(f, customer, rows=rows), star["customer"], "customer_sk", customer, customer, "checkin_date") if "customer" in star else f


def order_total() -> Column:
    return (F.coalesce("total_labour_amount", F.lit(0)) + F.coalesce("total_part_amount", F.lit(0))).cast("decimal(18,2)")


def repair_order(orders: DataFrame, lines: DataFrame, star: Star, calendar: Calendar) -> DataFrame:
    """One row an order, updated as its stages pass, with the labour hours that its lines sold."""
    f = order_keys(orders, star, lines=lines)
    stages = {r: F.to_date(f"{r}_ts") for r in ("checkin", "inspection", "parts_ready", "repair_start", "repair_end", "qc", "delivery")}
    return f.withColumns(_dates(calendar, appointment=F.col("appointment_date"), **stages) | {"total_amount": order_total(), "repair_order_count": F.lit(1)})


def repair_order_line(lines: DataFrame, orders: DataFrame, star: Star) -> DataFrame:
    """Lines, a table, with the keys of their order's fact, and the part as of check-in; labour has no part (-2). Only lines that name a part look it up: the rest would be one key."""
    keys = ("repair_order_no", "checkin_date", "checkin_date_key", "vehicle_sk", "customer_sk", "dealer_sk", "technician_sk", "service_type_sk")
    head, rows = orders.select(*(k for k in keys if k in orders.columns)), lines.count()
    f = dealt(lines, "repair_order_no", rows=rows).join(head, "repair_order_no")
    named = F.coalesce((F.col("line_type") != "LABOUR") | F.col("line_type").isNull(), F.lit(True)) & F.col("part_no").isNotNull()
    parts = lookup_as_of(dealt(f.where(named), "part_no", rows=rows), star["part"], "part_sk", "part_no", "part_no", "checkin_date")
    rest = f.where(~named).withColumn("part_sk", F.when(F.col("line_type") == "LABOUR", -2).otherwise(-1).cast("long"))
    return parts.unionByName(rest).withColumn("line_count", F.lit(1)).drop("checkin_date")


def part_purchase(purchases: DataFrame, star: Star, calendar: Calendar) -> DataFrame:
    """Order lines, a table, with the supplier and the part as of the order's date."""
    suppliers = star["supplier"].select(F.col("supplier_id").alias("_id"), F.col("supplier_sk").alias("_sk"))
    f = lookup(purchases, suppliers, F.col("supplier_id") == F.col("_id"), "_sk", "supplier_sk").drop("_id", "_sk")
    f = lookup_as_of(dealt(f, "part_no", rows=purchases.count()), star["part"], "part_sk", "part_no", "part_no", "order_date")
    return f.withColumns(_dates(calendar, order=F.col("order_date"), promised=F.col("promised_date"), delivery=F.col("delivery_date")) | {"po_line_count": F.lit(1)})


def _versions(dim: DataFrame, key: str, sk: str, name: str) -> DataFrame:
    """A key's versions in one row: a handful each, so that days pick theirs without a range join."""
    real = dim.where((F.col(sk) > 0) & F.col(key).isNotNull())
    return real.groupBy(F.col(key).alias(f"_{name}_key")).agg(F.collect_list(F.struct("valid_from", "valid_to", F.col(sk).alias("sk"))).alias(f"_{name}"))


def _pieces(df: DataFrame, versions: list[str], start: str, end: str) -> DataFrame:
    """One row for each piece `_from` to `_to` of [start, end) within which no version of these lists begins or ends."""
    bounds = F.concat(*(F.coalesce(F.col(v)[at], F.array().cast("array<date>")) for v in versions for at in ("valid_from", "valid_to")))
    cuts = F.array_sort(F.array_distinct(F.filter(bounds, lambda x: (x > F.col(start)) & (x < F.col(end)))))
    cut = df.withColumn("_cuts", F.concat(F.array(start), cuts, F.array(end)))
    spans = F.transform(F.slice("_cuts", 1, F.size("_cuts") - 1), lambda x, i: F.struct(x.alias("_from"), F.get("_cuts", i + 1).alias("_to")))
    return cut.withColumn("_span", F.explode(spans)).select("*", "_span._from", "_span._to").drop("_cuts", "_span")


def _in_stock(vehicles: DataFrame, contracts: DataFrame, star: Star, as_of: str) -> DataFrame:
    """Pieces `_from` to `_to` of each vehicle's time in stock with the keys that hold throughout."""
    sold = contracts.where("sale_type = 'NEW' and delivery_date is not null").groupBy("vin").agg(F.min("delivery_date").alias("_sold"))
    f = vehicles.where("arrival_date is not null").join(sold, "vin", "left").withColumn("exit_date", F.coalesce("_sold", F.lit(as_of).cast("date")))
    keys = {"vehicle": "vin", "dealer": "stock_dealer_code", "model": "model_trim_code"}
    names = {"vehicle": "vin", "dealer": "dealer_code", "model": "model_trim_code"}
    for name, key in keys.items():
        v = _versions(star[name], names[name], f"{name}_sk", name)
        f = f.join(v, F.col(key) == F.col(f"_{name}_key"), "left")
    f = _pieces(f.where(F.col("arrival_date") < F.col("exit_date")), [f"_{n}" for n in keys], "arrival_date", "exit_date")
    at = F.col("_from")
    held = {f"{n}_sk": F.coalesce(F.get(F.filter(f"_{n}", lambda v: (at >= v["valid_from"]) & (at < v["valid_to"])), 0)["sk"], F.lit(-1)).alias(f"{n}_sk") for n in keys}
    return f.select("vin", "arrival_date", F.col("dealer_cost_try").alias("stock_value_amount"), "_from", "_to", *held.values())  # days copy no versions


def inventory_daily(vehicles: DataFrame, contracts: DataFrame, star: Star, as_of: str) -> DataFrame:
    """One row a vehicle and day in stock: from arrival to the first new sale's delivery, else to `as_of`, which is left out."""
    f = expand_days(_in_stock(vehicles, contracts, star, as_of), "_from", "_to", "snapshot_date")
    day = F.col("snapshot_date")
    age = F.datediff(day, F.col("arrival_date"))
    return f.select("vin", C.date_key(day).alias("snapshot_date_key"), "vehicle_sk", "dealer_sk", "model_sk", age.alias("days_in_stock"), "stock_value_amount", F.lit(1).alias("vehicle_count"), C.age_band(age).alias("age_band"))


def inventory_by_age(vehicles: DataFrame, contracts: DataFrame, star: Star, as_of: str, sums: dict[str, str]) -> DataFrame:
    """`inventory_daily` by day and age band: vehicles, the oldest's days, and sums of its columns (name: column).

    No vehicle is expanded into its days. Vehicles of one arrival date have one age on a day, so pieces are added at
    their first day and taken off at their end, by arrival date and day; running sums give each arrival date's stock.
    Rows are as many as pieces up to the first aggregate, then at most arrival dates x days.
    """
    ends = F.inline(F.array(*(F.struct(F.col(c).alias("_day"), F.lit(n).alias("_n")) for c, n in (("_from", 1), ("_to", -1)))))
    pieces = _in_stock(vehicles, contracts, star, as_of).select("arrival_date", *dict.fromkeys(sums.values()), ends)
    signed = lambda c: F.sum(F.when(F.col("_n") > 0, F.col(c)).otherwise(-F.col(c)))
    held = lambda c: F.sum(F.when(F.col(c).isNotNull(), F.col("_n")))  # noqa: E731, values that are not null
    moves = pieces.groupBy("arrival_date", "_day").agg(F.sum("_n").alias("_n"), *(signed(c).alias(f"_s_{n}") for n, c in sums.items()), *(held(c).alias(f"_h_{n}") for n, c in sums.items()))
    by = Window.partitionBy("arrival_date").orderBy("_day")
    running = [f"{p}{n}" for n in sums for p in ("_s_", "_h_")]
    stock = moves.select("arrival_date", "_day", F.lead("_day").over(by).alias("_until"), *(F.sum(c).over(by).alias(c) for c in ("_n", *running)))
    days = expand_days(stock.where("_n > 0"), "_day", "_until", "_at")
    age = F.datediff("_at", "arrival_date")
    aged = days.select(C.date_key(F.col("_at")).alias("snapshot_date_key"), C.age_band(age).alias("age_band"), age.alias("_age"), "_n", *running)
    kind = {n: "decimal(28,2)" if c == "stock_value_amount" else "long" for n, c in sums.items()}
    totals = (F.when(F.sum(f"_h_{n}") > 0, F.sum(f"_s_{n}")).cast(kind[n]).alias(n) for n in sums)
    return aged.groupBy("snapshot_date_key", "age_band").agg(F.sum("_n").alias("vehicles"), F.max("_age").alias("oldest"), *totals)


def recall_coverage(coverage: DataFrame, campaigns: DataFrame, orders: DataFrame, star: Star, calendar: Calendar, as_of: str) -> DataFrame:
    """Vehicles of a campaign, by their current version; the dealer is that of the latest recall visit."""
    last = Window.partitionBy("vin").orderBy(F.col("checkin_ts").desc_nulls_last(), F.desc("repair_order_no"))
    visit = orders.where("service_type_code = 'RECALL' and vin is not null").withColumn("_rn", F.row_number().over(last)).where("_rn = 1").select("vin", F.col("dealer_code").alias("_visited"))
    current = lambda name, key, *more: star[name].where(f"is_current and {name}_sk > 0").select(F.col(key).alias(f"_{name}"), F.col(f"{name}_sk").alias(f"_{name}_sk"), *more)
    f = coverage.join(campaigns.select("campaign_code", "campaign_name", "category", "launch_date"), "campaign_code")
    f = f.join(current("vehicle", "vin", F.col("model_trim_code").alias("_code")), F.col("vin") == F.col("_vehicle"), "left")
    f = f.join(current("model", "model_trim_code"), F.col("_code") == F.col("_model"), "left").join(visit, "vin", "left")
    f = f.join(current("dealer", "dealer_code"), F.col("_visited") == F.col("_dealer"), "left")
    unknown = {f"{n}_sk": F.coalesce(f"_{n}_sk", F.lit(-1)) for n in ("vehicle", "model", "dealer")}
    waiting = F.when((F.col("is_completed") == 0) & F.col("notified_date").isNotNull(), F.datediff(F.lit(as_of).cast("date"), "notified_date"))
    dates = _dates(calendar, launch=F.col("launch_date"), notified=F.col("notified_date"), completed=F.col("completed_date"))
    return f.withColumns(unknown | dates | {"days_outstanding": waiting, "coverage_count": F.lit(1)}).drop("_vehicle", "_vehicle_sk", "_code", "_model", "_model_sk", "_visited", "_dealer", "_dealer_sk")


def data_quality(results: DataFrame, calendar: Calendar, executed: Column) -> DataFrame:
    """One row a rule and batch: what it saw, and what went to quarantine."""
    return results.withColumns(_dates(calendar, executed=executed) | {"rows_quarantined": F.when(F.col("severity") == "critical", F.col("rows_violated")).otherwise(0), "rule_execution_count": F.lit(1)})


def monthly_sales(sales: DataFrame) -> DataFrame:
    """By month, dealer and model; sales outside the calendar don't count."""
    n = lambda cond: F.count_if(cond)
    amounts = ("list_price", "discount_amount", "net_sale_amount", "vehicle_margin_amount")
    rate = F.when(F.sum("list_price") > 0, F.sum("discount_amount").cast("double") / F.sum("list_price").cast("double"))
    return sales.where("contract_date_key > 0").groupBy(F.expr("contract_date_key div 100").cast("int").alias("month_key"), "dealer_sk", "model_sk").agg(
        F.count("*").alias("sale_count"), n(F.col("sale_type") == "NEW").alias("new_sale_count"), n(F.col("sale_type") == "USED").alias("used_sale_count"), n(F.col("trade_in_vehicle_sk") > 0).alias("trade_in_count"),
        *(F.sum(c).alias(c) for c in amounts), rate.alias("avg_discount_rate"), F.avg(F.col("days_in_stock").cast("decimal(9,2)")).alias("avg_days_in_stock"),
    )


def monthly_targets(budget: DataFrame, sales: DataFrame, orders: DataFrame) -> DataFrame:
    """Targets beside actual sales and service, by month and dealer code, so that sales under older versions of a dealer count."""
    metric = lambda code: F.sum(F.when(F.col("metric_code") == code, F.col("target_value")))
    t = budget.groupBy((F.col("budget_year") * 100 + F.col("budget_month")).alias("month_key"), "dealer_code").agg(metric("VEHICLE_SALES_COUNT").alias("target_sale_count"), metric("VEHICLE_SALES_AMOUNT").alias("target_sale_amount"), metric("SERVICE_REVENUE_AMOUNT").alias("target_service_amount"))
    month = lambda c: F.expr(f"{c} div 100").cast("int").alias("month_key")
    a = sales.where("contract_date_key > 0").groupBy(month("contract_date_key"), "dealer_code").agg(F.count("*").alias("actual_sale_count"), F.sum("net_sale_amount").alias("actual_sale_amount"))
    b = orders.where("checkin_date_key > 0").groupBy(month("checkin_date_key"), "dealer_code").agg(F.sum("total_amount").alias("actual_service_amount"))
    actual = ("actual_sale_count", "actual_sale_amount", "actual_service_amount")
    return t.join(a, ["month_key", "dealer_code"], "left").join(b, ["month_key", "dealer_code"], "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in actual})


def monthly_service(orders: DataFrame) -> DataFrame:
    """By month, dealer and service type. Capacity is at the grain of `service_capacity`, so that types don't multiply it."""
    sums = ("labour_hours_sold", "total_labour_amount", "total_part_amount", "total_warranty_amount", "customer_payable_amount")
    return orders.where("checkin_date_key > 0").groupBy(F.expr("checkin_date_key div 100").cast("int").alias("month_key"), "dealer_sk", "service_type_sk").agg(
        F.count("*").alias("repair_order_count"), F.sum("is_open").alias("open_order_count"), *(F.sum(c).alias(c) for c in sums),
        F.avg("total_cycle_hours").alias("avg_cycle_hours"), F.avg("parts_wait_hours").alias("avg_parts_wait_hours"), F.count("parts_wait_hours").alias("orders_with_parts_wait"),
    )


def order_measures(orders: DataFrame, lines: DataFrame | None, calendar: Calendar) -> DataFrame:
    """The measures of `repair_order` alone, a row an order, with no key of a dimension: for aggregates that need few of those.

    `orders` are typed stages and amounts; without `lines` the labour hours sold are left out.
    """
    hours = {"parts_wait_hours": ("parts_wait_start_ts", "parts_ready_ts"), "total_cycle_hours": ("checkin_ts", "delivery_ts")}
    f = orders.withColumns({n: C.hours_between(F.col(a), F.col(b)) for n, (a, b) in hours.items()} | {"is_open": F.col("delivery_ts").isNull().cast("int"), "checkin_date": F.to_date("checkin_ts")})
    f = f.withColumns({"checkin_date_key": date_key_or_unknown(F.col("checkin_date"), *calendar), "total_amount": order_total()})
    if lines is None:
        return f
    sold = lines.where("line_type = 'LABOUR'").groupBy("repair_order_no").agg(F.sum("labour_hours").alias("labour_hours_sold"))
    return f.join(sold, "repair_order_no", "left")


def monthly_service_by_day(orders: DataFrame, star: Star) -> DataFrame:
    """`monthly_service` from `order_measures`: dealers and service types are looked up for sums by code and day, not for orders."""
    sums = ("labour_hours_sold", "total_labour_amount", "total_part_amount", "total_warranty_amount", "customer_payable_amount", "total_cycle_hours", "parts_wait_hours")
    daily = orders.where("checkin_date_key > 0").groupBy("dealer_code", "service_type_code", "checkin_date", "checkin_date_key").agg(
        F.count("*").alias("_n"), F.sum("is_open").alias("_open"), *(F.sum(c).alias(c) for c in sums), F.count("total_cycle_hours").alias("_cycles"), F.count("parts_wait_hours").alias("_waits")
    )
    daily = lookup_as_of(daily, star["dealer"], "dealer_sk", "dealer_code", "dealer_code", "checkin_date")
    types = star["service_type"].select(F.col("service_type_code").alias("_code"), F.col("service_type_sk").alias("_sk"))
    daily = lookup(daily, F.broadcast(types), F.col("service_type_code") == F.col("_code"), "_sk", "service_type_sk")  # nine rows
    average = lambda c, n: F.try_divide(F.sum(c), F.sum(n)).cast("decimal(16,6)")
    return daily.groupBy(F.expr("checkin_date_key div 100").cast("int").alias("month_key"), "dealer_sk", "service_type_sk").agg(
        F.sum("_n").alias("repair_order_count"), F.sum("_open").alias("open_order_count"), *(F.sum(c).cast(orders.schema[c].dataType.simpleString().replace("18,", "28,").replace("12,", "22,")).alias(c) for c in sums[:5]),
        average("total_cycle_hours", "_cycles").alias("avg_cycle_hours"), average("parts_wait_hours", "_waits").alias("avg_parts_wait_hours"), F.sum("_waits").alias("orders_with_parts_wait"),
    )


def sale_rows(contracts: DataFrame, arrivals: DataFrame, versions: DataFrame, calendar: Calendar) -> DataFrame:
    """The measures of `vehicle_sale`, a row a contract, with keys of no dimension but whether the trade-in is known.

    `arrivals`: vin, arrival_date; `versions`: the vehicle's versions, by vin, with dealer_cost_amount. Both are met by
    the contract's vehicle, in one shuffle of it; only contracts with a trade-in meet the versions again.
    """
    f = contracts.join(arrivals.select("vin", F.col("arrival_date").alias("_arrival")), "vin", "left")
    v = versions.select(F.col("vin").alias("_k"), F.col("valid_from").alias("_f"), F.col("valid_to").alias("_t"), "dealer_cost_amount")
    f = f.join(v, (F.col("vin") == F.col("_k")) & (F.col("contract_date") >= F.col("_f")) & (F.col("contract_date") < F.col("_t")), "left").drop("_k", "_f", "_t")
    traded, rest = f.where("trade_in_vin <> ''"), f.where("not coalesce(trade_in_vin <> '', false)")
    v = v.drop("dealer_cost_amount").withColumn("_known", F.lit(1))
    traded = traded.join(v, (F.col("trade_in_vin") == F.col("_k")) & (F.col("contract_date") >= F.col("_f")) & (F.col("contract_date") < F.col("_t")), "left").withColumn("trade_in_vehicle_sk", F.coalesce("_known", F.lit(-1))).drop("_k", "_f", "_t", "_known")
    f = traded.unionByName(rest.withColumn("trade_in_vehicle_sk", F.lit(-2)))
    return f.withColumns({
        "contract_date_key": date_key_or_unknown(F.col("contract_date"), *calendar), "days_in_stock": C.days_between(F.col("_arrival"), F.col("delivery_date")),
        "vehicle_margin_amount": (F.col("net_sale_amount") - F.coalesce("dealer_cost_amount", F.lit(0))).cast("decimal(18,2)"),
        "order_to_delivery_days": C.days_between(F.col("contract_date"), F.col("delivery_date")),
    }).drop("_arrival")


def service_capacity(service: DataFrame, dealers: DataFrame, dates: DataFrame) -> DataFrame:
    """Hours sold and available by month and dealer: a month's capacity stands for 22 working days."""
    days = dates.groupBy("month_key").agg(F.sum("is_working_day").alias("working_days"))
    sold = service.groupBy("month_key", "dealer_sk").agg(F.sum("labour_hours_sold").alias("labour_hours_sold"))
    out = sold.join(F.broadcast(days), "month_key").join(dealers.select("dealer_sk", "monthly_capacity_hours"), "dealer_sk", "left")  # months of a calendar
    hours = F.col("monthly_capacity_hours") * F.col("working_days") / 22.0
    return out.withColumns({"available_labour_hours": hours.cast("double"), "utilisation": F.try_divide(F.col("labour_hours_sold").cast("double"), hours.cast("double"))})
