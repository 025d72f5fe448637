"""Calendar, provinces, roles of dates, inferred members and survivorship over the shop's tables and the star, each beside DuckDB SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeforge.operators import calendar, matching, measures, provinces, scd2
from lakeforge.operators.keys import date_key_or_unknown, latest_by_key, lookup_as_of
from lakeforge.plans import entities as E
from lakeforge.plans.registry import query, table

_text = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
_names = lambda rows, i: "[" + ", ".join(_text(r[i]) for r in rows) + "]"


def _cents(c: str):
    """Hundredths that can't be told apart by rounding; values that are no numbers are none."""
    return F.col(c).try_cast("decimal(18,2)")


def _calendar_sql(first: str, last: str) -> str:
    """CTEs marks and dates."""
    fixed = ", ".join(f"({m}, {d}, {_text(n)}, {int(h)})" for m, d, n, h in calendar.FIXED_HOLIDAYS)
    feasts = ", ".join(f"(DATE '{d}', {_text(n)}, {k})" for d, n, k in calendar.FEASTS)
    return f"""all_marks AS (
  SELECT make_date(y, m, d) AS day, name, half FROM range(year(DATE '{first}'), year(DATE '{last}') + 1) AS r(y), (VALUES {fixed}) AS h(m, d, name, half)
  UNION ALL SELECT f.first - 1, name || ' Arifesi', 1 FROM (VALUES {feasts}) AS f(first, name, days)
  UNION ALL SELECT f.first + i::INT, name, 0 FROM (VALUES {feasts}) AS f(first, name, days), range(5) AS r(i) WHERE i < days),
marks AS (SELECT day, coalesce(min(name) FILTER (half = 0), min(name)) AS holiday_name, min(half) AS half FROM all_marks GROUP BY day),
days AS (SELECT unnest(generate_series(DATE '{first}', DATE '{last}', INTERVAL 1 DAY))::DATE AS f),
dates AS (
  SELECT strftime(f, '%Y%m%d')::INT AS date_key, f AS full_date, day(f) AS day_of_month, dayofyear(f) AS day_of_year, isodow(f) AS day_of_week, {_names(calendar.DAYS, 0)}[isodow(f)] AS day_name,
  {_names(calendar.DAYS, 1)}[isodow(f)] AS day_name_en, {_names(calendar.DAYS, 2)}[isodow(f)] AS day_short, week(f) AS iso_week, isoyear(f) AS iso_year, (f - (isodow(f) - 1)::INT)::DATE AS week_start_date,
  month(f) AS month_number, {_names(calendar.MONTHS, 0)}[month(f)] AS month_name, {_names(calendar.MONTHS, 1)}[month(f)] AS month_name_en, year(f) * 100 + month(f) AS month_key, strftime(f, '%Y-%m') AS month_year_label,
  date_trunc('month', f)::DATE AS first_day_of_month, last_day(f) AS last_day_of_month, day(last_day(f)) AS days_in_month, quarter(f) AS quarter_number, year(f) || '-Q' || quarter(f) AS quarter_label, year(f) AS year_number,
  year(f) AS fiscal_year, quarter(f) AS fiscal_quarter, month(f) AS fiscal_month, (isodow(f) >= 6)::INT AS is_weekend, coalesce(half = 0, false)::INT AS is_public_holiday, coalesce(half = 1, false)::INT AS is_half_day, holiday_name,
  (isodow(f) < 6 AND NOT coalesce(half = 0, false))::INT AS is_working_day, CASE WHEN f - INTERVAL 1 YEAR >= DATE '{first}' THEN strftime(f - INTERVAL 1 YEAR, '%Y%m%d')::INT END AS same_date_last_year_key,
  CASE WHEN f - INTERVAL 1 YEAR >= DATE '{first}' THEN (year(f) - 1) * 100 + month(f) END AS same_month_last_year_key
  FROM days LEFT JOIN marks ON day = f
  UNION ALL SELECT -1, '1900-01-01', 0, 0, 0, 'Bilinmiyor', 'Unknown', 'Blm', 0, 0, '1900-01-01', 0, 'Bilinmiyor', 'Unknown', 0, 'Unknown', '1900-01-01', '1900-01-01', 0, 0, 'Unknown', 0, 0, 0, 0, 0, 0, 0, NULL, 0, NULL, NULL)"""


SHOP_YEARS = ("2024-01-01", "2024-12-31")


@query(f"""WITH {_calendar_sql(*SHOP_YEARS)},
s AS (SELECT CASE WHEN sold_at::DATE BETWEEN DATE '{SHOP_YEARS[0]}' AND DATE '{SHOP_YEARS[1]}' THEN strftime(sold_at, '%Y%m%d')::INT ELSE -1 END AS date_key, count(*) AS sale_count, sum(try_cast(total AS DECIMAL(18,2))) AS amount FROM sales GROUP BY 1)
SELECT d.*, coalesce(sale_count, 0) AS sale_count, amount FROM dates d LEFT JOIN s USING (date_key)""")
def sales_calendar(spark, d):
    """Every day of the calendar with what was sold on it; sales without a day, or outside, are with the member -1."""
    day = date_key_or_unknown(F.to_date("sold_at"), *SHOP_YEARS)
    sold = table(spark, d, "sales").groupBy(day.alias("date_key")).agg(F.count("*").alias("sale_count"), F.sum(_cents("total")).alias("amount"))
    return calendar.dim_date(spark, *SHOP_YEARS).join(sold, "date_key", "left").withColumn("sale_count", F.coalesce("sale_count", F.lit(0)))


_YEARS = E.CALENDAR
_ROLE_SQL = "WITH " + _calendar_sql(*_YEARS) + ", f_all AS (" + E._with("SELECT contract_date_key, delivery_date_key, registration_date_key, net_sale_amount FROM f_sale") + """)
SELECT c.quarter_label AS contract_quarter, v.quarter_label AS delivery_quarter, r.year_number AS registration_year, count(*) AS sale_count, sum(net_sale_amount) AS net_sale
FROM f_all JOIN dates c ON c.date_key = contract_date_key JOIN dates v ON v.date_key = delivery_date_key JOIN dates r ON r.date_key = registration_date_key GROUP BY 1, 2, 3"""


@query(_ROLE_SQL)
def sales_by_date_roles(spark, d):
    """One calendar in three roles: when sales were agreed, delivered and registered."""
    dates = calendar.dim_date(spark, *_YEARS)
    s = E._sales(spark, d)
    for role in ("contract", "delivery", "registration"):
        s = s.join(F.broadcast(calendar.as_role(dates, role)), f"{role}_date_key")  # a row a day
    return s.groupBy("contract_quarter", "delivery_quarter", "registration_year").agg(F.count("*").alias("sale_count"), F.sum("net_sale_amount").alias("net_sale"))


@query(E._with("SELECT dealer_sk, k AS dealer_code, dealer_name, city, monthly_capacity_hours FROM d_dealer WHERE is_current UNION ALL SELECT -1, '-1', NULL, NULL, NULL UNION ALL SELECT -2, '-2', NULL, NULL, NULL"))
def current_dealers(spark, d):
    """The dealers as they are now, and the special members."""
    return calendar.current(E._dealers(spark, d)).select("dealer_sk", "dealer_code", "dealer_name", "city", "monthly_capacity_hours")


_PROVINCES = ", ".join(f"({_text(c)}, {_text(n)}, {_text(r)}, {p or 'NULL'}::DECIMAL(9,2))" for c, n, r, p in [*provinces.PROVINCES, provinces.UNKNOWN])


@query(f"""WITH p(code, name, region, population_m) AS (VALUES {_PROVINCES}), c AS (SELECT lpad((nation_id * 4 + 1)::VARCHAR, 2, '0') AS code, try_cast(balance AS DECIMAL(18,2)) AS b FROM clients),
n AS (SELECT p.region, count(*) AS clients, sum(b) AS balance FROM c LEFT JOIN p USING (code) GROUP BY 1), m AS (SELECT region, count(*) AS provinces, sum(population_m) AS population_m FROM p GROUP BY 1)
SELECT n.region, clients, balance, coalesce(provinces, 0) AS provinces, population_m FROM n LEFT JOIN m ON m.region = n.region""")
def clients_by_region(spark, d):
    """Clients by the region of their province, none where the code is of no province, with what the reference says of the region."""
    c = table(spark, d, "clients").select(F.lpad((F.col("nation_id") * 4 + 1).cast("string"), 2, "0").alias("city_code"), _cents("balance").alias("b"))
    n = provinces.with_region(c, "city_code").groupBy("region").agg(F.count("*").alias("clients"), F.sum("b").alias("balance"))
    m = provinces.provinces(spark).groupBy("region").agg(F.count("*").alias("provinces"), F.sum("population_m").alias("population_m"))
    return n.join(m, "region", "left").withColumn("provinces", F.coalesce("provinces", F.lit(0)))


_TRACKED = ["source", "segment", "city"]
_SIGN = " || '|' || ".join(f"coalesce({c}, '')" for c in _TRACKED)


@query(f"""WITH s AS (SELECT client_id AS k, {', '.join(_TRACKED)}, valid_at::DATE AS day, {_SIGN} AS h FROM client_changes WHERE client_id IS NOT NULL AND valid_at IS NOT NULL AND coalesce(op, '') <> 'D'
  QUALIFY row_number() OVER (PARTITION BY client_id, valid_at::DATE ORDER BY valid_at DESC, change_id DESC) = 1),
v AS (SELECT k, day, h, lag(h) OVER (PARTITION BY k ORDER BY day) AS b FROM s),
dim AS (SELECT k, day AS f, coalesce(lead(day) OVER (PARTITION BY k ORDER BY day), DATE '9999-12-31') AS t, row_number() OVER (ORDER BY k, day) AS sk FROM v WHERE b IS NULL OR b <> h),
x AS (SELECT DISTINCT sale_id, client_id, sold_at::DATE AS day FROM sales),
new AS (SELECT client_id AS k, min(day) AS f FROM x WHERE client_id IS NOT NULL AND day IS NOT NULL AND client_id NOT IN (SELECT k FROM dim) GROUP BY 1),
whole AS (SELECT k, f, t, sk, false AS i FROM dim UNION ALL SELECT k, f, DATE '9999-12-31', row_number() OVER (ORDER BY k) + (SELECT coalesce(max(sk), 0) FROM dim), true FROM new)
SELECT x.sale_id, x.client_id, coalesce(sk, -1) AS client_sk, coalesce(i, false) AS is_inferred FROM x LEFT JOIN whole w ON w.k = x.client_id AND x.day >= w.f AND x.day < w.t""")
def sales_with_inferred_clients(spark, d):
    """Each sale with the client's version of its day. Clients that no change names are inferred before the sales look them up."""
    changes = table(spark, d, "client_changes").where(F.col("valid_at").isNotNull() & (F.coalesce("op", F.lit("")) != "D")).withColumn("order", F.struct("valid_at", "change_id"))
    clients = scd2.load_dimension(changes, "client_id", _TRACKED, "valid_at", "order", "client_sk", specials=())
    sales = table(spark, d, "sales").select("sale_id", "client_id", F.to_date("sold_at").alias("day")).distinct()
    seen = sales.where("day is not null").select("client_id", F.col("day").alias("seen"))
    whole = scd2.with_inferred(clients, [seen], "client_id", "client_sk")
    out = lookup_as_of(sales, whole, "client_sk", "client_id", "client_id", "day", columns=("is_inferred",))
    return out.select("sale_id", "client_id", "client_sk", F.coalesce("is_inferred", F.lit(False)).alias("is_inferred"))


_SIDE_SQL = """SELECT master_id AS {id}, 'T' || CASE WHEN {no} THEN master_id END AS identity_no, name AS full_name, nullif(email, '') AS email, '+' || client_id AS phone, city, lpad(nation_id::VARCHAR, 2, '0') AS city_code,
 segment AS customer_type, name || ', ' || city AS address_line, source AS lead_source, balance > 1000 AS consent, updated_at::DATE AS customer_since, updated_at AS modified
 FROM clients WHERE source IN ({sources}) AND master_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY master_id ORDER BY updated_at DESC NULLS LAST, client_id) = 1"""
_RICH = "length({0}) + 3 * length(regexp_replace({0}, '[A-Za-z0-9 .]', '', 'g'))"
_GOLDEN_SQL = f"""WITH l AS ({_SIDE_SQL.format(id='store_id', no='master_id % 3 <> 0', sources="'store', 'web'")}), r AS ({_SIDE_SQL.format(id='crm_id', no='master_id % 2 = 0', sources="'crm', 'partner'")}),
b AS (SELECT l.*, r.crm_id, r.identity_no AS r_identity, r.full_name AS r_name, r.email AS r_email, r.phone AS r_phone, r.city AS r_city, r.customer_type AS r_type, r.lead_source AS r_source, r.consent AS r_consent, r.modified AS r_modified,
 store_id IS NOT NULL AS in_l, crm_id IS NOT NULL AS in_r, NOT (store_id IS NOT NULL) OR (crm_id IS NOT NULL AND coalesce(r.modified >= l.modified, false)) AS newer FROM l FULL JOIN r ON store_id = crm_id),
golden AS (SELECT store_id, crm_id, CASE WHEN in_l AND in_r THEN 60 + 20 * coalesce(email = r_email, false)::INT ELSE 0 END AS match_score, CASE WHEN in_l THEN customer_type ELSE r_type END AS customer_type, coalesce(identity_no, r_identity) AS identity_no,
 CASE WHEN coalesce({_RICH.format('full_name')} >= {_RICH.format('r_name')}, r_name IS NULL) THEN full_name ELSE r_name END AS full_name, coalesce(r_email, email) AS email, CASE WHEN newer THEN r_phone ELSE phone END AS phone,
 CASE WHEN newer THEN r_city ELSE city END AS city, city_code, address_line, r_source AS lead_source, r_consent AS consent, customer_since, greatest(modified, r_modified) AS modified,
 CASE WHEN in_l AND in_r THEN 'BOTH' WHEN in_l THEN 'STORE_ONLY' ELSE 'CRM_ONLY' END AS source_presence FROM b)
"""


def _side(df: DataFrame, name: str, sources: tuple[str, ...], numbered) -> DataFrame:
    own = latest_by_key(df.where(F.col("source").isin(*sources) & F.col("master_id").isNotNull()), ["master_id"], [F.col("updated_at").desc_nulls_last(), "client_id"])
    return own.select(
        F.col("master_id").alias(name), F.concat(F.lit("T"), F.when(numbered, F.col("master_id"))).alias("identity_no"), F.col("name").alias("full_name"), F.nullif("email", F.lit("")).alias("email"), F.concat(F.lit("+"), "client_id").alias("phone"),
        "city", F.lpad(F.col("nation_id").cast("string"), 2, "0").alias("city_code"), F.col("segment").alias("customer_type"), F.concat("name", F.lit(", "), "city").alias("address_line"), F.col("source").alias("lead_source"),
        (F.col("balance") > 1000).alias("consent"), F.to_date("updated_at").alias("customer_since"), F.col("updated_at").alias("modified"),
    )


def _golden(spark, d) -> DataFrame:
    c = table(spark, d, "clients")
    store = _side(c, "store_id", ("store", "web"), F.col("master_id") % 3 != 0)
    crm = _side(c, "crm_id", ("crm", "partner"), F.col("master_id") % 2 == 0)
    same_mail = F.coalesce(store["email"] == crm["email"], F.lit(False)).cast("int")
    pairs = store.join(crm, store["store_id"] == crm["crm_id"]).select("store_id", "crm_id", (60 + 20 * same_mail).alias("match_score"))
    return matching.survive(pairs, store, crm, "store_id", "crm_id", presence=("BOTH", "STORE_ONLY", "CRM_ONLY"))


@query(_GOLDEN_SQL + "SELECT * FROM golden")
def customer_survivorship(spark, d):
    """One record a customer of two systems, every attribute by its rule."""
    return _golden(spark, d)


@query(_GOLDEN_SQL + "SELECT source_presence, customer_type, count(*) AS customers, count(*) FILTER (match_score >= 80) AS sure, count(email) AS with_email FROM golden GROUP BY 1, 2")
def customer_mix(spark, d):
    """Customers by where they are known, and how many of the matches are sure."""
    return _golden(spark, d).groupBy("source_presence", "customer_type").agg(F.count("*").alias("customers"), F.count_if(F.col("match_score") >= 80).alias("sure"), F.count("email").alias("with_email"))


@query(E._with("""SELECT CASE WHEN country_code = 'TR' THEN 'DOMESTIC' ELSE 'IMPORT' END AS origin, count(*) AS po_lines, sum(line_amount) AS purchase_amount, sum(is_late) AS late_lines, round(1 - sum(is_late)::DOUBLE / nullif(count(is_late), 0), 6) AS on_time_rate
FROM f_purchase JOIN raw_supplier USING (supplier_id) GROUP BY 1"""))
def dashboard_on_time(spark, d):
    """Deliveries on time by where suppliers are."""
    origin = E._suppliers(spark, d).select("supplier_sk", F.when(F.col("is_domestic") == 1, "DOMESTIC").otherwise("IMPORT").alias("origin"))
    out = measures.purchase_measures(E._purchase_facts(spark, d).join(origin, "supplier_sk"), ["origin"])
    return out.select("origin", "po_lines", "purchase_amount", "late_lines", F.round("on_time_rate", 6).alias("on_time_rate"))
