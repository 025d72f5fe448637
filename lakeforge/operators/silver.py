"""Typed entities from raw text: specs for masters, functions for transactions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeforge.functions import cleaning as C
from lakeforge.operators.keys import dealt, latest_by_key, stored, with_rate

BASE_CURRENCY = "TRY"


@dataclass(frozen=True)
class Spec:
    """How a raw entity is typed. `order`: the raw column by which a key's latest row is chosen, then the time of ingestion."""

    name: str
    keys: tuple[str, ...]
    order: str | None = "last_modified_ts"
    strings: tuple[str, ...] = ()
    upper: tuple[str, ...] = ()
    integers: tuple[str, ...] = ()
    longs: tuple[str, ...] = ()
    dates: tuple[str, ...] = ()
    timestamps: tuple[str, ...] = ()
    decimals: tuple[str, ...] = ()
    quantities: tuple[str, ...] = ()
    rates: tuple[str, ...] = ()
    others: tuple[str, ...] = ()
    comma: bool = False
    vin: str | None = None
    plate: str | None = None


# The columns of the raw feeds and their types.
MASTERS = {
    s.name: s
    for s in (
        Spec("dealer", ("dealer_code",), strings=("dealer_code", "dealer_name", "dealer_type", "province_code", "city", "region", "address_line", "phone"), integers=("workshop_bay_count", "monthly_capacity_hours", "is_active"), dates=("opening_date",), timestamps=("last_modified_ts",), comma=True),
        Spec("employee", ("employee_id",), strings=("employee_id", "first_name", "last_name", "full_name", "dealer_code", "role_code", "email"), integers=("is_active",), dates=("hire_date",), timestamps=("last_modified_ts",), comma=True),
        Spec("model_trim", ("model_trim_code",), strings=("model_trim_code", "brand", "model_name", "trim_name", "body_type", "segment", "fuel_type", "transmission"), integers=("model_year", "engine_cc", "warranty_months", "warranty_km", "is_active"), timestamps=("last_modified_ts",), decimals=("list_price_try",), comma=True),
        Spec("part", ("part_no",), strings=("part_no", "part_name", "part_group_code", "part_group_name", "supplier_id", "unit_of_measure"), integers=("is_genuine", "is_active"), timestamps=("last_modified_ts",), decimals=("list_price_try",)),
        Spec("supplier", ("supplier_id",), strings=("supplier_id", "supplier_name", "country_code", "contact_email"), integers=("lead_time_days", "is_active"), timestamps=("last_modified_ts",)),
        Spec("vehicle", ("vin",), strings=("model_trim_code", "colour", "stock_dealer_code", "engine_no", "status", "owner_customer_id"), upper=("vin",), integers=("model_year", "is_active"), dates=("production_date", "arrival_date"), timestamps=("last_modified_ts",), decimals=("dealer_cost_try",), comma=True, vin="vin", plate="plate_number"),
        Spec("fx_rate", ("rate_date", "currency_code"), order=None, strings=("currency_code",), dates=("rate_date",), rates=("rate_to_try",)),
    )
}
CONTRACT = Spec("sales_contract", ("contract_no",), "contract_date", strings=("contract_no", "dealer_code", "salesperson_id", "customer_id", "model_trim_code"), upper=("vin", "trade_in_vin", "sale_type", "payment_type", "channel", "currency_code"), integers=("is_campaign",), dates=("contract_date", "delivery_date", "invoice_date", "registration_date"), decimals=("list_price", "discount_amount", "net_sale_amount", "trade_in_amount"), comma=True, vin="vin", plate="plate_number")
STAGES = ("checkin_ts", "inspection_ts", "parts_wait_start_ts", "parts_ready_ts", "repair_start_ts", "repair_end_ts", "qc_ts", "delivery_ts")
ORDER = Spec("repair_order", ("repair_order_no",), "checkin_ts", strings=("repair_order_no", "dealer_code", "customer_id", "service_advisor_id", "technician_id"), upper=("vin", "service_type_code", "status"), integers=("is_warranty",), longs=("odometer_km",), dates=("appointment_date",), timestamps=STAGES, decimals=("total_labour_amount", "total_part_amount", "total_warranty_amount", "customer_payable_amount"), vin="vin", plate="plate_number")
LINE = Spec("repair_order_line", ("repair_order_no", "line_no"), None, strings=("repair_order_no", "part_no", "operation_code", "description"), upper=("line_type",), integers=("line_no",), decimals=("labour_hours", "unit_price", "discount_amount", "line_amount", "warranty_amount", "customer_amount"), quantities=("quantity",))
PURCHASE = Spec("purchase_order_line", ("po_no", "po_line_no"), "order_date", strings=("po_no", "supplier_id", "part_no"), upper=("status", "currency_code"), integers=("po_line_no",), dates=("order_date", "promised_date", "delivery_date"), decimals=("unit_cost", "line_amount"), quantities=("ordered_quantity", "received_quantity"))
CLAIM = Spec("warranty_claim", ("claim_no",), "claim_date", strings=("claim_no", "repair_order_no", "dealer_code", "service_type_code", "rejection_reason"), upper=("vin", "status"), dates=("claim_date", "decision_date"), decimals=("claimed_amount", "approved_amount"))
CAMPAIGN = Spec("recall_campaign", ("campaign_code",), None, strings=("campaign_code", "campaign_name"), upper=("category",), integers=("affected_vehicle_count",), dates=("launch_date", "production_from", "production_to"), others=("affected_models", "affected_model_trim_codes"))
COVERAGE = Spec("recall_coverage", ("campaign_code", "vin"), None, strings=("campaign_code",), upper=("vin",), integers=("is_completed",), dates=("notified_date", "completed_date"))
BUDGET = Spec("budget", ("dealer_code", "budget_year", "budget_month", "metric_code"), None, strings=("dealer_code",), upper=("metric_code", "currency_code"), integers=("budget_year", "budget_month"), decimals=("target_value",))
ENTITIES = MASTERS | {s.name: s for s in (CONTRACT, ORDER, LINE, PURCHASE, CLAIM, CAMPAIGN, COVERAGE, BUDGET)}


def load(raw: DataFrame, spec: Spec, salt: str = "") -> DataFrame:
    """The latest row of each key, typed. Raw dates stay beside the typed ones of keys that rules look at, as `<column>_raw`.

    The latest: by the order column as a time, then as text, then by `_ingest_ts` and the row's hash, so that mixed date
    formats sort rightly and ties don't depend on partitions. Columns that the feed lacks are null. Rows are shuffled as
    they come: hashes and times are worked out behind the shuffle, and nothing is sorted before it.
    """
    business = [c for c in raw.columns if not c.startswith("_")]
    rows = latest_by_key(dealt(raw, *spec.keys), list(spec.keys), [*_order(spec), C.row_hash(business).desc()])
    return _typed(rows, raw.columns, spec, salt)


def load_columns(raw: DataFrame, spec: Spec, columns: Sequence[str], salt: str = "", then: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Some columns of `load`, with the same rows. Only what they need is read, shuffled and typed; written once, with what `then` makes of them.

    Numbers are typed before the shuffle, texts before the sort, dates, times, and columns of the keys and of the order
    behind it: typed in one step, a wide entity would make a method too long to be compiled. The row's hash, which needs all
    columns, decides between rows of a key that tie in all else. Such keys are noted on the way, and only their rows are
    read again, whole.
    """
    source = lambda c: spec.vin if c.startswith("vin_") else spec.plate if c.startswith("plate_") else c.removesuffix("_raw")
    fixed = [*spec.keys, *((spec.order,) if spec.order else ())]
    last = [c for c in columns if source(c) in fixed or c in (*spec.dates, *spec.timestamps)]
    first = [c for c in columns if c not in last and c in (*spec.integers, *spec.longs, *spec.decimals, *spec.quantities, *spec.rates)]
    middle = [c for c in columns if c not in last and c not in first]
    texts = lambda names: [c for c in dict.fromkeys((*fixed, *map(source, names))) if c in raw.columns]
    some = lambda names: [F.col(c) for c in names]
    narrow = dealt(_typed(raw, raw.columns, spec, salt, first, some((*texts(middle + last), "_ingest_ts"))), *spec.keys, rows=raw.count())
    narrow = _typed(narrow, raw.columns, spec, salt, middle, some((*texts(last), *first, "_ingest_ts")))
    values = _order_values(spec)
    timed = narrow.withColumns({f"_o{i}": c for i, c in enumerate(values)})
    order = [F.col(f"_o{i}") for i in range(len(values))]
    by = Window.partitionBy(*spec.keys).orderBy(*(c.desc_nulls_last() for c in order))
    latest = timed.withColumns({"_n": F.row_number().over(by), "_next": F.lead(F.struct(*order)).over(by)}).where("_n = 1")
    tie = F.col("_next").eqNullSafe(F.struct(*order))
    keys = [F.when(tie, F.col(k)).alias(f"_k{i}") for i, k in enumerate(spec.keys)]
    rows = _typed(latest, raw.columns, spec, salt, last, [*some(first + middle), *keys, tie.alias("_tie")])
    noted = [*(f"_k{i}" for i in range(len(keys))), "_tie"]
    held = stored(then(rows.select(*columns, *noted)))
    tied = held.where("_tie").select(*noted[:-1]).distinct()
    if tied.isEmpty():
        return held.drop(*noted)
    whole = raw.join(tied, reduce(lambda a, b: a & b, (raw[k].eqNullSafe(tied[f"_k{i}"]) for i, k in enumerate(spec.keys))), "left_semi")
    return held.where("not _tie").drop(*noted).unionByName(then(load(whole, spec, salt).select(*columns)))


def _order_values(spec: Spec) -> list[Column]:
    """By what a key's rows are ordered, the latest first; the row's hash decides what this leaves open."""
    if not spec.order:
        return [F.col("_ingest_ts")]
    time = F.coalesce(C.parse_timestamp(F.col(spec.order)), C.parse_date(F.col(spec.order)).cast("timestamp"))
    return [time, F.col(spec.order), F.col("_ingest_ts")]


def _order(spec: Spec) -> list[Column]:
    return [c.desc_nulls_last() for c in _order_values(spec)]


def _typed(rows: DataFrame, fed: Sequence[str], spec: Spec, salt: str, columns: Sequence[str] | None = None, more: Sequence[Column] = ()) -> DataFrame:
    """A feed's rows as its spec types them: all columns, or some, and `more`. `fed`: the feed's columns."""
    at = lambda c: F.col(c).cast("string") if c in fed else F.lit(None).cast("string")
    kinds: list[tuple[tuple[str, ...], object]] = [
        (spec.strings, C.clean_string), (spec.upper, lambda c: F.upper(C.clean_string(c))), (spec.integers, lambda c: c.try_cast("int")), (spec.longs, lambda c: c.try_cast("bigint")),
        (spec.dates, C.parse_date), (spec.timestamps, C.parse_timestamp), (spec.decimals, lambda c: C.parse_decimal(c, spec.comma)),
        (spec.quantities, lambda c: C.parse_decimal(c, spec.comma, 18, 3)), (spec.rates, lambda c: C.parse_decimal(c, spec.comma, 18, 6)),
    ]
    wanted = lambda c: columns is None or c in columns
    out = [kind(at(c)).alias(c) for names, kind in kinds for c in names if wanted(c)]
    out += [F.col(c) if c in fed else F.lit(None).alias(c) for c in spec.others if wanted(c)]
    if spec.name == "sales_contract":
        out += [at(c).alias(f"{c}_raw") for c in ("contract_date", "delivery_date", "registration_date") if wanted(f"{c}_raw")]
    checked = {}
    if spec.vin and any(wanted(n) for n in ("vin_well_formed", "vin_check_digit_valid")):
        out.append(F.upper(C.clean_string(at(spec.vin))).alias("_vin"))
        checked |= {"vin_well_formed": F.col("_fine").cast("int"), "vin_check_digit_valid": C.vin_signs_valid("_signs", "_vin")}
    if spec.plate and any(wanted(n) for n in ("plate_hash", "plate_masked")):
        out.append(F.upper(C.clean_string(at(spec.plate))).alias("_plate"))
        checked |= {"plate_hash": C.hash_pii(F.col("_plate"), salt), "plate_masked": C.mask_plate(F.col("_plate"))}
    checked = {n: c for n, c in checked.items() if wanted(n)}
    typed_rows = rows.select(*out, *more)
    if "_vin" in typed_rows.columns:
        # a step each: what is named several times is worked out once
        fine = typed_rows.withColumn("_fine", C.vin_shaped(F.col("_vin")))
        typed_rows = fine.withColumn("_signs", F.when(F.col("_fine"), C.vin_signs(F.col("_vin"))))
    return typed_rows.withColumns(checked).drop("_vin", "_fine", "_signs", "_plate") if checked else typed_rows


def typed(raw: DataFrame, spec: Spec, columns: Sequence[str]) -> dict[str, Column]:
    """Columns of all rows of a feed as its spec types them; others, and those of times, are cleaned text. Columns that the feed lacks are null."""

    def one(c: str) -> Column:
        text = F.col(c).cast("string") if c in raw.columns else F.lit(None).cast("string")
        if c in spec.decimals:
            return C.parse_decimal(text, spec.comma)
        return text.try_cast("int") if c in spec.integers else F.upper(C.clean_string(text)) if c in spec.upper else C.clean_string(text)

    return {c: one(c) for c in columns}


def without(df: DataFrame, prefixes: tuple[str, ...] = ("_",), suffixes: tuple[str, ...] = ()) -> DataFrame:
    """The columns whose names begin with none of the prefixes and end with none of the suffixes."""
    return df.select(*(c for c in df.columns if not c.startswith(prefixes) and not (suffixes and c.endswith(suffixes))))


def audited(df: DataFrame, system: str, batch_id: str) -> DataFrame:
    """With the source system, batch, time and a hash of the business columns."""
    business = without(df).columns
    return df.withColumns({"_source_system": F.lit(system), "_batch_id": F.lit(batch_id), "_loaded_ts": F.current_timestamp(), "_row_hash": C.row_hash(business)})


def in_base(df: DataFrame, fx: DataFrame, amounts: tuple[str, ...], date: str) -> DataFrame:
    out = with_rate(df, fx.select(F.col("currency_code").alias("currency"), F.col("rate_date").alias("fx_date"), F.col("rate_to_try").alias("rate")), "currency_code", date, BASE_CURRENCY, "fx_rate_to_try")
    return out.withColumns({c: (F.col(c) * F.col("fx_rate_to_try")).cast("decimal(18,2)") for c in amounts})


def with_master(df: DataFrame, xref: DataFrame) -> DataFrame:
    return df.join(xref.select("customer_id", "master_customer_id"), "customer_id", "left")


def sales_contract(raw: DataFrame, fx: DataFrame, vehicles: DataFrame, xref: DataFrame, salt: str = "") -> DataFrame:
    """Contracts in the base currency, with days in stock, discount rate, and the margin over the trade-in."""
    out = in_base(load(raw, CONTRACT, salt), fx, CONTRACT.decimals, "contract_date")
    out = with_master(out.join(vehicles.select("vin", F.col("arrival_date").alias("_arrival")), "vin", "left"), xref)
    return out.withColumns({
        "days_in_stock": C.days_between(F.col("_arrival"), F.col("delivery_date")), "discount_rate": C.ratio(F.col("discount_amount"), F.col("list_price")),
        "gross_margin_amount": (F.col("net_sale_amount") - F.coalesce(F.col("trade_in_amount"), F.lit(0))).cast("decimal(18,2)"),
    }).drop("_arrival")


def repair_order(raw: DataFrame, xref: DataFrame, salt: str = "") -> DataFrame:
    """Orders with the hours between their stages. Touch time counts a missing part as none."""
    spans = {"inspection_wait_hours": (0, 1), "parts_wait_hours": (2, 3), "repair_duration_hours": (4, 5), "qc_wait_hours": (5, 6), "collection_wait_hours": (6, 7), "total_cycle_hours": (0, 7)}
    out = load(raw, ORDER, salt).withColumns({name: C.hours_between(F.col(STAGES[a]), F.col(STAGES[b])) for name, (a, b) in spans.items()})
    touch = F.coalesce("repair_duration_hours", F.lit(0)) + F.coalesce("inspection_wait_hours", F.lit(0))
    return with_master(out.withColumns({"touch_time_hours": touch, "is_open": F.col("delivery_ts").isNull().cast("int")}), xref)


def purchase_order_line(raw: DataFrame, fx: DataFrame) -> DataFrame:
    """Order lines in the base currency, with delay, lateness and what was not received."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = in_base(load(raw, PURCHASE), fx, PURCHASE.decimals, "order_date").withColumn("delay_days", C.days_between(F.col("promised_date"), F.col("delivery_date")))
    return out.withColumns({"is_late": C.late_flag(F.col("delay_days")), "shortfall_quantity": (zero("ordered_quantity") - zero("received_quantity")).cast("decimal(18,3)")})


def warranty_claim(raw: DataFrame) -> DataFrame:
    unpaid: Column = (F.col("claimed_amount") - F.coalesce(F.col("approved_amount"), F.lit(0))).cast("decimal(18,2)")
    return load(raw, CLAIM).withColumns({"unreimbursed_amount": unpaid, "decision_days": C.days_between(F.col("claim_date"), F.col("decision_date"))})


def recall_coverage(raw: DataFrame) -> DataFrame:
    return load(raw, COVERAGE).withColumn("days_to_complete", C.days_between(F.col("notified_date"), F.col("completed_date")))
