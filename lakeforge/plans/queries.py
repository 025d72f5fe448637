"""Named queries of the library's operators over the star tables, each beside DuckDB SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeforge.functions import cleaning as C
from lakeforge.operators import keys as K
from lakeforge.operators import measures, quality, scd2
from lakeforge.plans import entities, gold, model_queries, quality_queries, shop, tracked_queries  # noqa: F401, they register their queries
from lakeforge.plans.registry import QUERIES, SQL, Query, query
from lakeforge.plans.registry import money as _money
from lakeforge.plans.registry import table as _t


@query("""SELECT strftime(l_shipdate, '%Y%m')::INT AS month_key, l_returnflag, count(*) AS line_count, sum(l_extendedprice::DECIMAL(18,2)) AS amount,
 sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS closed_count, round(sum(l_extendedprice::DECIMAL(18,2) * l_discount::DECIMAL(9,4))::DOUBLE / nullif(sum(l_extendedprice::DECIMAL(18,2)), 0)::DOUBLE, 6) AS discount_rate
 FROM lineitem GROUP BY 1, 2""")
def monthly_sales(spark, d):
    """Monthly aggregate with conditional counts and a weighted rate."""
    l = _t(spark, d, "lineitem").select(C.month_key(F.col("l_shipdate")).alias("month_key"), "l_returnflag", "l_linestatus", _money("l_extendedprice").alias("p"), F.col("l_discount").cast("decimal(9,4)").alias("r"))
    return l.groupBy("month_key", "l_returnflag").agg(F.count("*").alias("line_count"), F.sum("p").alias("amount"), F.sum(F.when(F.col("l_linestatus") == "F", 1).otherwise(0)).alias("closed_count"), F.round(F.sum(F.col("p") * F.col("r")).cast("double") / F.sum("p").cast("double"), 6).alias("discount_rate"))


@query("""SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) = 1""")
def latest_order_by_customer(spark, d):
    return K.latest_by_key(_t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").desc()])


@query("""WITH s AS (SELECT o_custkey, max(o_orderpriority) AS p FROM orders WHERE o_orderdate < DATE '1998-01-01' GROUP BY 1), t AS (SELECT o_custkey, max(o_orderpriority) AS p FROM orders WHERE o_orderdate >= DATE '1998-01-01' GROUP BY 1)
 SELECT action, count(*) AS n FROM (SELECT CASE WHEN s.o_custkey IS NULL THEN 'missing' WHEN t.o_custkey IS NULL THEN 'insert' WHEN s.p = t.p THEN 'unchanged' ELSE 'update' END AS action FROM t FULL JOIN s USING (o_custkey)) GROUP BY action""")
def upsert_actions(spark, d):
    """Change-hash classification of an upsert: the customers of the later years as the target, those before as the source."""
    o = _t(spark, d, "orders").groupBy("o_custkey", (F.col("o_orderdate") < "1998-01-01").alias("early")).agg(F.max("o_orderpriority").alias("p")).withColumn("_row_hash", C.row_hash(["p"]))
    return K.classify_changes(o.where("not early"), o.where("early"), ["o_custkey"]).groupBy("action").agg(F.count("*").alias("n"))


_VERSIONS = """v0 AS (SELECT o_custkey AS k, o_orderstatus AS s, o_orderdate::DATE AS day FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate::DATE ORDER BY o_orderkey DESC) = 1),
v1 AS (SELECT *, lag(s) OVER (PARTITION BY k ORDER BY day) AS b FROM v0), v2 AS (SELECT * FROM v1 WHERE b IS NULL OR b <> s),
v AS (SELECT k, s, day AS valid_from, coalesce(lead(day) OVER (PARTITION BY k ORDER BY day), DATE '9999-12-31') AS valid_to, lead(day) OVER (PARTITION BY k ORDER BY day) IS NULL AS is_current FROM v2)"""


def _versions(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("s"), "o_orderdate", "o_orderkey")
    return scd2.backfill(o, "k", ["s"], "o_orderdate", "o_orderkey")


@query(f"WITH {_VERSIONS} SELECT k, s, valid_from, valid_to, is_current FROM v")
def scd2_backfill(spark, d):
    """Type 2 versions from dated snapshots."""
    return _versions(spark, d).select("k", "s", "valid_from", "valid_to", "is_current")


@query(f"""WITH {_VERSIONS} SELECT count(*) AS broken_whole, (SELECT count(*) FROM (SELECT k FROM v GROUP BY k HAVING count(*) > 1)) AS broken_without_current FROM v WHERE valid_to <= valid_from""")
def scd2_integrity(spark, d):
    """No broken key among the versions; each key with several is broken once its current version is taken away."""
    v = _versions(spark, d)
    n = lambda x, name: scd2.integrity(x, "k").agg(F.count("*").alias(name))
    return n(v, "broken_whole").crossJoin(n(v.where("not is_current"), "broken_without_current"))  # two single rows


@query(f"""WITH {_VERSIONS}, src AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'X' ELSE 'O' END AS s FROM customer),
ch AS (SELECT v.k FROM v JOIN src ON v.k = src.k WHERE v.is_current AND v.s <> src.s),
fresh AS (SELECT src.k, src.s FROM src WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.is_current AND v.k = src.k AND v.s = src.s))
SELECT k, s, valid_from, CASE WHEN is_current AND k IN (SELECT k FROM ch) THEN DATE '2005-01-01' ELSE valid_to END AS valid_to, is_current AND k NOT IN (SELECT k FROM ch) AS is_current FROM v
UNION ALL SELECT k, s, DATE '2005-01-01', DATE '9999-12-31', true FROM fresh""")
def scd2_incremental(spark, d):
    """A nightly change set on the backfilled versions."""
    src = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 4 == 0, "X").otherwise("O").alias("s"))
    return scd2.apply_changes(_versions(spark, d), src, "k", ["s"], "2005-01-01").select("k", "s", "valid_from", "valid_to", "is_current")


@query(f"""WITH {_VERSIONS} SELECT coalesce(v.s, '?') AS status_then, count(*) AS n FROM orders o LEFT JOIN v ON v.k = o.o_custkey AND o.o_orderdate::DATE - 30 >= v.valid_from AND o.o_orderdate::DATE - 30 < v.valid_to GROUP BY 1""")
def temporal_lookup(spark, d):
    """Facts joined to the version that held thirty days before."""
    o = _t(spark, d, "orders").select("o_custkey", F.date_sub(F.to_date("o_orderdate"), 30).alias("day"))
    return K.temporal_join(o, _versions(spark, d), "o_custkey", "day", "k", ["s"]).groupBy(F.coalesce("s", F.lit("?")).alias("status_then")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT 'C' || (n_nationkey % 5) AS currency, DATE '1995-01-01' + (n_nationkey * 97 % 900)::INT AS fx_date, (1 + n_nationkey / 8.0)::DECIMAL(18,6) AS rate FROM nation),
i AS (SELECT *, coalesce(lead(fx_date) OVER (PARTITION BY currency ORDER BY fx_date), DATE '9999-12-31') AS until FROM r),
o AS (SELECT o_orderkey, 'C' || (o_custkey % 6) AS currency, o_orderdate::DATE AS day, o_totalprice::DECIMAL(18,2) AS amount FROM orders)
SELECT o.currency, count(*) AS n, count(rate) + sum(CASE WHEN o.currency = 'C5' THEN 1 ELSE 0 END) AS n_rated, sum(round(amount * CASE WHEN o.currency = 'C5' THEN 1 ELSE rate END, 2)::DECIMAL(18,2)) AS amount_base
FROM o LEFT JOIN i ON o.currency = i.currency AND day >= fx_date AND day < until GROUP BY 1""")
def fx_conversion(spark, d):
    """Forward-filled exchange rates; nothing before the first."""
    r = _t(spark, d, "nation").select(F.concat(F.lit("C"), (F.col("n_nationkey") % 5).cast("string")).alias("currency"), F.date_add(F.lit("1995-01-01").cast("date"), F.col("n_nationkey") * 97 % 900).alias("fx_date"), (1 + F.col("n_nationkey") / 8.0).cast("decimal(18,6)").alias("rate"))
    o = _t(spark, d, "orders").select("o_orderkey", F.concat(F.lit("C"), (F.col("o_custkey") % 6).cast("string")).alias("cur"), F.to_date("o_orderdate").alias("day"), _money("o_totalprice").alias("amount"))
    out = K.to_base_currency(o, r, "amount", "cur", "day", "C5", "base").drop("currency").withColumnRenamed("cur", "currency")
    return out.groupBy("currency").agg(F.count("*").alias("n"), F.count("base").alias("n_rated"), F.sum("base").alias("amount_base"))


@query("""WITH s AS (SELECT o_orderkey, o_orderdate::DATE AS a, o_orderdate::DATE + (o_orderkey % 40)::INT AS b FROM orders)
SELECT day::DATE AS day, count(*) AS in_stock, max(datediff('day', a, day::DATE)) AS oldest FROM s, unnest(generate_series(a::TIMESTAMP, (b - 1)::TIMESTAMP, INTERVAL 1 DAY)) AS g(day) WHERE a < b GROUP BY 1""")
def daily_inventory(spark, d):
    """Stock intervals expanded to days, without a range join."""
    s = _t(spark, d, "orders").select(F.to_date("o_orderdate").alias("a"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 40).cast("int")).alias("b"))
    return K.expand_days(s, "a", "b", "day").groupBy("day").agg(F.count("*").alias("in_stock"), F.max(F.datediff("day", "a")).alias("oldest"))


@query("""WITH s AS (SELECT o_orderdate::DATE AS day, o_totalprice::DECIMAL(18,2) AS p FROM orders), e AS (SELECT strftime(day, '%Y%m')::INT AS period, max(day) AS day FROM s GROUP BY 1)
SELECT period, count(*) AS n, sum(p) AS value FROM s JOIN e USING (day) GROUP BY 1""")
def semi_additive_stock(spark, d):
    """Measures at the last date of each month."""
    s = _t(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), _money("o_totalprice").alias("p"))
    return measures.at_period_end(s, "day", C.month_key(F.col("day")), [F.count("*").alias("n"), F.sum("p").alias("value")])


@query("""WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, o_orderpriority, sum(o_totalprice::DECIMAL(18,2)) AS amount FROM orders GROUP BY 1, 2)
SELECT a.month, a.o_orderpriority, a.amount, b.amount AS amount_ly, round((a.amount - b.amount)::DOUBLE / b.amount::DOUBLE, 6) AS yoy FROM m a LEFT JOIN m b ON a.o_orderpriority = b.o_orderpriority AND a.month = (b.month + INTERVAL 12 MONTH)::DATE""")
def year_over_year(spark, d):
    m = _t(spark, d, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month"), "o_orderpriority").agg(F.sum(_money("o_totalprice")).alias("amount"))
    out = measures.with_prior_year(m, "month", ["o_orderpriority"], "amount")
    return out.select("month", "o_orderpriority", "amount", "amount_ly", F.round((F.col("amount") - F.col("amount_ly")).cast("double") / F.col("amount_ly").cast("double"), 6).alias("yoy"))


@query("""SELECT count(*) AS base, count(*) FILTER (k IN (SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '1998-01-01')) AS retained,
count(*) FILTER (k IN (SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '1998-01-01'))::DOUBLE / count(*) AS rate FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate < DATE '1998-01-01')""")
def customer_retention(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderdate")
    return measures.retention(o.where("o_orderdate < date'1998-01-01'"), o.where("o_orderdate >= date'1998-01-01'"), "k")


@query("""SELECT l_linestatus, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity::DECIMAL(18,3) END) AS a, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity::DECIMAL(18,3) END) AS n, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity::DECIMAL(18,3) END) AS r FROM lineitem GROUP BY 1""")
def pivot_by_flag(spark, d):
    """A pivot over a stated list, which needs no first pass for its values."""
    l = _t(spark, d, "lineitem").select("l_linestatus", "l_returnflag", F.col("l_quantity").cast("decimal(18,3)").alias("q"))
    return l.groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("q")).withColumnsRenamed({"A": "a", "N": "n", "R": "r"})


@query("""WITH r AS (SELECT 'ORPHAN' AS rule_code, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')) AS v, (SELECT count(*) FROM lineitem) AS e
UNION ALL SELECT 'NEGATIVE', (SELECT count(*) FROM lineitem WHERE l_quantity < 0), (SELECT count(*) FROM lineitem) UNION ALL SELECT 'ROLLBACK', (SELECT count(*) FROM (SELECT o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders) WHERE o_totalprice < b), (SELECT count(*) FROM orders))
SELECT rule_code, v AS rows_violated, e AS rows_evaluated, CASE WHEN v = 0 THEN 'PASSED' WHEN v::DOUBLE / e > 0.15 THEN 'SUSPECT' ELSE 'FAILED' END AS status FROM r""")
def quality_rules(spark, d):
    """Rules as data: an orphan rule, a range rule and a monotonicity rule."""
    tables = {"lineitem": _t(spark, d, "lineitem"), "orders": _t(spark, d, "orders")}
    rules = [
        quality.Rule("ORPHAN", "lineitem", "critical", lambda t: quality.orphans(t["lineitem"], "l_orderkey", t["orders"].where("o_orderstatus <> 'P'"), "o_orderkey").select(F.col("l_orderkey").alias("business_key"), F.lit("no order").alias("detail"))),
        quality.Rule("NEGATIVE", "lineitem", "critical", lambda t: t["lineitem"].where("l_quantity < 0").select(F.col("l_orderkey").alias("business_key"), F.col("l_quantity").alias("detail"))),
        quality.Rule("ROLLBACK", "orders", "warning", lambda t: quality.rollbacks(t["orders"].withColumn("_at", F.struct("o_orderdate", "o_orderkey")), "o_custkey", "_at", "o_totalprice").select(F.col("o_orderkey").alias("business_key"), F.col("previous").alias("detail"))),
    ]
    return quality.run_rules(tables, rules)[0].select("rule_code", "rows_violated", "rows_evaluated", "status")


@query("""WITH s AS (SELECT c_custkey AS k, 'TR' || lpad(c_custkey::VARCHAR, 9, '0') AS id, '+90 5' || lpad((c_custkey * 7919 % 1000000000)::VARCHAR, 9, '0') AS p, lower(replace(c_name, '#', '.')) || '@mail.example' AS m FROM customer)
SELECT k, substr(id, 1, 3) || '*****' || right(id, 3) AS id_masked, substr(regexp_replace(p, '[^0-9]', '', 'g'), 1, 4) || '*****' || right(p, 2) AS phone_masked, m[1] || '***@mail.example' AS mail_masked, sha256('salt' || id) AS id_hash, right(regexp_replace(p, '[^0-9]', '', 'g'), 10) AS phone_key FROM s""")
def mask_customers(spark, d):
    k = F.col("c_custkey")
    s = _t(spark, d, "customer").select(k.alias("k"), F.concat(F.lit("TR"), F.lpad(k.cast("string"), 9, "0")).alias("id"), F.concat(F.lit("+90 5"), F.lpad((k * 7919 % 1000000000).cast("string"), 9, "0")).alias("p"), F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@mail.example")).alias("m"))
    return s.select("k", C.mask_identity_no(F.col("id")).alias("id_masked"), C.mask_phone(F.col("p")).alias("phone_masked"), C.mask_email(F.col("m")).alias("mail_masked"), C.hash_pii(F.col("id"), "salt").alias("id_hash"), C.phone_key(F.col("p")).alias("phone_key"))


@query("""SELECT d::DATE AS date, strftime(d, '%Y%m%d')::INT AS date_key, strftime(d, '%Y%m')::INT AS month_key, week(d)::INT AS iso_week, isoyear(d)::INT AS iso_year, isodow(d)::INT AS iso_day, quarter(d)::INT AS quarter, last_day(d)::DATE AS month_end,
strftime(d - INTERVAL 12 MONTH, '%Y%m%d')::INT AS ly_date_key, CASE WHEN isodow(d) < 6 AND strftime(d, '%m%d') NOT IN ('0101', '0423', '0501', '0519', '0715', '0830', '1029') THEN 1 ELSE 0 END AS is_working_day
FROM generate_series(TIMESTAMP '2022-01-01', TIMESTAMP '2027-12-31', INTERVAL 1 DAY) AS g(d)""")
def date_dimension(spark, d):
    """Calendar with fixed public holidays; half days count as working."""
    marks = [(f"{y}-{md}", md != "10-28") for y in range(2022, 2028) for md in ("01-01", "04-23", "05-01", "05-19", "07-15", "08-30", "10-28", "10-29")]
    holidays = spark.createDataFrame(marks, "date string, full_day boolean").withColumn("date", F.to_date("date"))
    return measures.date_dimension(spark, "2022-01-01", "2027-12-31", holidays)


@query("""SELECT l_partkey AS k, min(l_shipdate)::DATE AS valid_from FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_type <> 'ECONOMY') GROUP BY 1""")
def inferred_parts(spark, d):
    """Late-arriving members from the first day that a fact names them."""
    seen = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.to_date("l_shipdate").alias("seen"))
    return scd2.inferred_members([seen], _t(spark, d, "part").where("p_type <> 'ECONOMY'").select(F.col("p_partkey").alias("k")), "k").select("k", "valid_from")


@query("""WITH f AS (SELECT DISTINCT (l_discount > 0.05)::INT AS discounted, (l_tax = 0)::INT AS tax_free, (l_quantity > 40)::INT AS bulk FROM lineitem)
SELECT discounted, tax_free, bulk, concat_ws(', ', CASE WHEN discounted = 1 THEN 'discounted' END, CASE WHEN tax_free = 1 THEN 'tax_free' END, CASE WHEN bulk = 1 THEN 'bulk' END) AS description, row_number() OVER (ORDER BY discounted, tax_free, bulk) AS sk FROM f""")
def junk_flags(spark, d):
    l = _t(spark, d, "lineitem").select((F.col("l_discount") > 0.05).cast("int").alias("discounted"), (F.col("l_tax") == 0).cast("int").alias("tax_free"), (F.col("l_quantity") > 40).cast("int").alias("bulk"))
    flags = ["discounted", "tax_free", "bulk"]
    return scd2.with_surrogate(scd2.junk_dimension([l], flags), flags, "sk").select(*flags, "description", "sk")


@query("""SELECT n_name, count(*) AS suppliers, sum(s_acctbal::DECIMAL(18,2)) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1 OR n_nationkey = 7 GROUP BY 1""")
def row_security(spark, d):
    """A user with a region grant, a key grant and an inactive grant."""
    grants = spark.createDataFrame([("u", "REGION", "1", True), ("u", "KEY", "7", True), ("u", "ALL", "", False), ("v", "ALL", "", True)], "user string, scope string, value string, active boolean")
    nations = measures.visible(_t(spark, d, "nation"), grants, "u", "n_nationkey", "n_regionkey")
    return _t(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("suppliers"), F.sum(_money("s_acctbal")).alias("balance"))


@query("""SELECT c_custkey, coalesce(sum(o_totalprice::DECIMAL(18,2)), 0) AS spent, count(o_orderkey) AS n_orders, CASE WHEN count(o_orderkey) = 0 THEN -1 ELSE max(o_orderkey) END AS last_order_sk FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def unknown_member_lookup(spark, d):
    o = _t(spark, d, "orders").groupBy("o_custkey").agg(F.sum(_money("o_totalprice")).alias("s"), F.count("*").alias("n"), F.max("o_orderkey").alias("sk"))
    out = K.lookup(_t(spark, d, "customer").select("c_custkey"), o, F.col("c_custkey") == F.col("o_custkey"), "sk", "last_order_sk")
    return out.select("c_custkey", F.coalesce("s", F.lit(0).cast("decimal(28,2)")).alias("spent"), F.coalesce("n", F.lit(0)).alias("n_orders"), "last_order_sk")


@query("""WITH x AS (SELECT l_suppkey, datediff('day', o_orderdate::DATE, l_shipdate::DATE) AS delay FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT CASE WHEN delay <= 30 THEN '0-30' WHEN delay <= 60 THEN '31-60' WHEN delay <= 90 THEN '61-90' WHEN delay <= 180 THEN '91-180' ELSE '180+' END AS band, count(*) AS n, sum(CASE WHEN delay > 2 THEN 1 ELSE 0 END) AS late, count(DISTINCT l_suppkey) AS suppliers FROM x GROUP BY 1""")
def delivery_bands(spark, d):
    """Delay bands and late flags over the order and line facts."""
    x = _t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate").join(_t(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.withColumn("delay", F.datediff("l_shipdate", "o_orderdate"))
    return x.groupBy(C.age_band(F.col("delay")).alias("band")).agg(F.count("*").alias("n"), F.sum(C.late_flag(F.col("delay"))).cast("long").alias("late"), F.countDistinct("l_suppkey").alias("suppliers"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
