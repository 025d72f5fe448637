"""Named queries of gold facts, measures, master data and raw-feed typing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeforge.functions import cleaning as C
from lakeforge.operators import matching, quality, scd2
from lakeforge.plans.registry import money, query, table


@query("""SELECT r_name AS region, strftime(o_orderdate, '%Y%m')::INT AS month_key, count(*) AS line_count, sum(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(9,4)))::DECIMAL(28,6) AS net_revenue,
 round(sum(l_extendedprice::DECIMAL(18,2) * l_discount::DECIMAL(9,4))::DOUBLE / nullif(sum(l_extendedprice::DECIMAL(18,2)), 0)::DOUBLE, 6) AS discount_rate
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def region_monthly_sales(spark: SparkSession, d: str) -> DataFrame:
    """Net revenue and weighted discount rate. Lines are summed by order first: the join then reuses that partitioning."""
    price, rate = money("l_extendedprice"), F.col("l_discount").cast("decimal(9,4)")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum(price).alias("p"), F.sum(price * rate).alias("off"))
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), C.month_key(F.col("o_orderdate")).alias("month_key"))
    per_customer = lines.join(orders, "o_orderkey").groupBy("c_custkey", "month_key").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum("off").alias("off"))
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("region"))
    joined = per_customer.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey").join(places, "c_nationkey")
    net, p = F.sum(F.col("p") - F.col("off")), F.sum("p").cast("double")
    return joined.groupBy("region", "month_key").agg(F.sum("n").alias("line_count"), net.cast("decimal(28,6)").alias("net_revenue"), F.round(F.try_divide(F.sum("off").cast("double"), p), 6).alias("discount_rate"))


@query("""WITH l AS (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,2)) AS s FROM lineitem GROUP BY 1)
SELECT o_orderstatus, count(*) AS n, sum(CASE WHEN s IS NULL THEN 1 ELSE 0 END)::BIGINT AS without_lines, sum(CASE WHEN abs(o_totalprice::DECIMAL(18,2) - s) > 0.02 THEN 1 ELSE 0 END)::BIGINT AS mismatched FROM orders LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY 1""")
def header_line_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Header totals against the sums of their lines."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(money("l_extendedprice")).alias("s"))
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", money("o_totalprice").alias("p")).join(lines, "o_orderkey", "left")
    return o.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.col("s").isNull()).alias("without_lines"), F.count_if(F.abs(F.col("p") - F.col("s")) > 0.02).alias("mismatched"))


@query("""WITH o AS (SELECT strftime(o_orderdate, '%Y%m')::INT AS month_key, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT strftime(l_shipdate, '%Y%m')::INT AS month_key, count(*) AS n FROM lineitem GROUP BY 1)
SELECT coalesce(o.month_key, s.month_key) AS month_key, coalesce(o.n, 0) AS ordered, coalesce(s.n, 0) AS shipped FROM o FULL JOIN s ON o.month_key = s.month_key""")
def role_playing_dates(spark: SparkSession, d: str) -> DataFrame:
    """One calendar in two roles: orders by order month, lines by ship month."""
    o = table(spark, d, "orders").groupBy(C.month_key(F.col("o_orderdate")).alias("month_key")).agg(F.count("*").alias("ordered"))
    s = table(spark, d, "lineitem").groupBy(C.month_key(F.col("l_shipdate")).alias("month_key")).agg(F.count("*").alias("shipped"))
    return o.join(s, "month_key", "full_outer").fillna(0)


@query("""WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, o_orderpriority, sum(o_totalprice::DECIMAL(18,2)) AS amount FROM orders GROUP BY 1, 2),
t AS (SELECT (month + INTERVAL 12 MONTH)::DATE AS month, o_orderpriority, amount AS target FROM m)
SELECT coalesce(t.month, m.month) AS month, coalesce(t.o_orderpriority, m.o_orderpriority) AS o_orderpriority, coalesce(target, 0)::DECIMAL(28,2) AS target, coalesce(amount, 0)::DECIMAL(28,2) AS actual, round(coalesce(amount, 0)::DOUBLE / nullif(target, 0)::DOUBLE, 6) AS achievement
FROM t FULL JOIN m ON t.month = m.month AND t.o_orderpriority = m.o_orderpriority""")
def target_vs_actual(spark: SparkSession, d: str) -> DataFrame:
    """Targets (the amounts of the year before) and actuals at their common grain."""
    m = table(spark, d, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month"), "o_orderpriority").agg(F.sum(money("o_totalprice")).cast("decimal(28,2)").alias("actual"))
    t = m.select(F.add_months("month", 12).alias("month"), "o_orderpriority", F.col("actual").alias("target"))
    zero = F.lit(0).cast("decimal(28,2)")
    out = t.join(m, ["month", "o_orderpriority"], "full_outer").withColumn("actual", F.coalesce("actual", zero))
    return out.select("month", "o_orderpriority", F.coalesce("target", zero).alias("target"), "actual", F.round(F.try_divide(F.col("actual").cast("double"), F.col("target").cast("double")), 6).alias("achievement"))


@query("""WITH b AS (SELECT strftime(l_shipdate, '%Y%m')::INT AS batch, count(*) AS evaluated, sum(CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END)::BIGINT AS violated FROM lineitem GROUP BY 1), r AS (SELECT *, round(violated / evaluated, 6) AS rate FROM b)
SELECT batch, evaluated, violated, rate, lag(rate) OVER (ORDER BY batch) AS rate_before FROM r""")
def violation_rate_vs_previous(spark: SparkSession, d: str) -> DataFrame:
    """Each batch's violation rate next to that of the batch before."""
    b = table(spark, d, "lineitem").groupBy(C.month_key(F.col("l_shipdate")).alias("batch")).agg(F.count("*").alias("evaluated"), F.count_if(F.col("l_quantity") > 45).alias("violated"))
    return quality.with_previous_rate(b.withColumn("rate", F.round(F.col("violated") / F.col("evaluated"), 6)), "batch", "rate")


@query("""WITH dim AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS sk FROM supplier WHERE s_acctbal > 0), n AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) + (SELECT coalesce(max(sk), 0) FROM dim) AS sk FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM dim))
SELECT s_suppkey, upper(s_name) AS s_name, sk FROM supplier JOIN (SELECT * FROM dim UNION ALL SELECT * FROM n) USING (s_suppkey)""")
def type1_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Known suppliers are overwritten and keep their keys, new ones get the next."""
    s = table(spark, d, "supplier")
    dim = scd2.with_surrogate(s.where("s_acctbal > 0").select("s_suppkey", "s_name"), ["s_suppkey"], "sk")
    return scd2.type1(dim, s.select("s_suppkey", F.upper("s_name").alias("s_name")), "s_suppkey", "sk")


_ONE_CALL = "+".join(f"w{i}*(CASE WHEN substr(v,{i + 1},1) BETWEEN '0' AND '9' THEN substr(v,{i + 1},1)::INT ELSE ascii(substr(v,{i + 1},1)) - 64 END)".replace(f"w{i}", str(w)) for i, w in enumerate(C.VIN_WEIGHTS))


@query(f"""WITH v AS (SELECT upper(substr(md5(p_partkey::VARCHAR), 1, 17)) AS v FROM part), c AS (SELECT v, ({_ONE_CALL}) % 11 AS r FROM v)
SELECT v AS vin, CASE WHEN r = 10 THEN 'X' ELSE r::VARCHAR END AS check_digit, (CASE WHEN r = 10 THEN 'X' ELSE r::VARCHAR END = substr(v, 9, 1))::INT AS valid FROM c""")
def vin_check_digits(spark: SparkSession, d: str) -> DataFrame:
    """Check digits of identification numbers made of hexadecimal digits."""
    v = table(spark, d, "part").select(F.upper(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 17)).alias("vin"))
    return v.select("vin", C.vin_check_digit(F.col("vin")).alias("check_digit"), C.vin_check_digit_valid(F.col("vin")).alias("valid"))


@query("""SELECT strftime(o_orderdate, '%Y%m')::INT AS month_key, count(*) AS n, sum(o_totalprice::DECIMAL(18,2)) AS amount FROM orders GROUP BY 1""")
def parse_mixed_text(spark: SparkSession, d: str) -> DataFrame:
    """Dates as text in three formats and amounts with decimal commas are typed again."""
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 3
    raw = table(spark, d, "orders").select(
        F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "dd.MM.yyyy")).otherwise(F.date_format(day, "dd/MM/yyyy")).alias("day"),
        F.translate(F.format_number(money("o_totalprice"), 2), ",.", ".,").alias("amount"),
    )
    typed = raw.select(C.month_key(C.parse_date(F.col("day"))).alias("month_key"), C.parse_decimal(F.col("amount"), comma=True).alias("amount"))
    return typed.groupBy("month_key").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


@query("""SELECT c_custkey, lower(c_mktsegment) || '@mail.example' AS mail, CASE WHEN c_acctbal > 0 THEN '5' || c_custkey END AS phone, CASE WHEN c_acctbal > 0 THEN 2 ELSE 1 END AS n_contacts FROM customer""")
def nested_contacts(spark: SparkSession, d: str) -> DataFrame:
    """The first contact of each kind out of an array of structs."""
    mail = F.struct(F.lit("mail").alias("kind"), F.concat(F.lower("c_mktsegment"), F.lit("@mail.example")).alias("value"))
    phone = F.struct(F.lit("phone").alias("kind"), F.concat(F.lit("5"), F.col("c_custkey").cast("string")).alias("value"))
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.array(phone, mail)).otherwise(F.array(mail)).alias("contacts"))
    first = lambda kind: F.get(F.filter("contacts", lambda x: x["kind"] == kind), 0)["value"]
    return c.select("c_custkey", first("mail").alias("mail"), first("phone").alias("phone"), F.size("contacts").alias("n_contacts"))


@query("""WITH c AS (SELECT CASE WHEN o_orderstatus = 'P' AND o_totalprice > 200000 THEN 'LARGE, OPEN' WHEN o_orderstatus = 'P' THEN 'OPEN' WHEN o_totalprice > 200000 THEN 'LARGE' ELSE '' END AS reason FROM orders) SELECT reason, count(*) AS n FROM c GROUP BY 1""")
def quarantine_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders with a critical violation leave, with all reasons; the rest stay."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    find = lambda text: lambda t: t["o"].where(text).select(F.col("o_orderkey").alias("business_key"), F.lit("").alias("detail"))
    rules = [quality.Rule("OPEN", "o", "critical", find("o_orderstatus = 'P'")), quality.Rule("LARGE", "o", "critical", find("o_totalprice > 200000")), quality.Rule("ALL", "o", "warning", find("true"))]
    clean, bad = quality.quarantine(o, "o_orderkey", quality.run_rules({"o": o}, rules)[1])
    return clean.select(F.lit("").alias("reason")).union(bad.select("quarantine_reason")).groupBy("reason").agg(F.count("*").alias("n"))


_SIDES = """a AS (SELECT c_custkey AS a_id, c_name AS name, '5' || lpad((c_custkey * 7919 % 1000000000)::VARCHAR, 9, '0') AS phone, lower(c_name) || '@mail.example' AS email, c_nationkey::VARCHAR AS city, DATE '1998-06-01' AS modified, c_mktsegment AS seg, c_acctbal AS bal FROM customer),
b AS (SELECT a_id AS b_id, upper(name) AS name, CASE WHEN seg IN ('FURNITURE', 'BUILDING') THEN phone END AS phone, CASE WHEN bal > 0 THEN email END AS email, city, max(o_orderdate)::DATE AS modified FROM a JOIN orders ON o_custkey = a_id GROUP BY ALL),
p AS (SELECT a_id, b_id, 25 + 8 + CASE WHEN a.phone = b.phone THEN 30 ELSE 0 END + CASE WHEN a.email = b.email THEN 20 ELSE 0 END AS score FROM a JOIN b ON a_id = b_id AND (a.phone = b.phone OR a.email = b.email)), m AS (SELECT * FROM p WHERE score >= 55)"""


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All customers, and those with orders as a second system knows them: in capitals, with gaps."""
    k = F.col("c_custkey")
    phone, email = F.concat(F.lit("5"), F.lpad((k * 7919 % 1000000000).cast("string"), 9, "0")), F.concat(F.lower("c_name"), F.lit("@mail.example"))
    c = table(spark, d, "customer").select(k.alias("id"), F.col("c_name").alias("name"), phone.alias("phone"), email.alias("email"), F.col("c_nationkey").cast("string").alias("city"), "c_mktsegment", "c_acctbal")
    seen = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.to_date(F.max("o_orderdate")).alias("modified"))
    a = c.withColumnRenamed("id", "a_id").withColumn("modified", F.lit("1998-06-01").cast("date")).drop("c_mktsegment", "c_acctbal")
    b = c.join(seen, "id").select(F.col("id").alias("b_id"), F.upper("name").alias("name"), F.when(F.col("c_mktsegment").isin("FURNITURE", "BUILDING"), F.col("phone")).alias("phone"), F.when(F.col("c_acctbal") > 0, F.col("email")).alias("email"), "city", "modified")
    return a, b


def _matches(a: DataFrame, b: DataFrame) -> DataFrame:
    x, y = (s.select(i, "phone", "email", *(F.col(n).alias(f"{i}_{n}") for n in ("phone", "email", "name", "city"))) for s, i in ((a, "a_id"), (b, "b_id")))
    pairs = matching.candidates(x, y, ["phone", "email"], "a_id", "b_id").join(x.drop("phone", "email"), "a_id").join(y.drop("phone", "email"), "b_id")
    both = lambda n: (F.col(f"a_id_{n}"), F.col(f"b_id_{n}"))
    none = (F.lit(None).cast("string"),) * 2
    name = tuple(C.normalise_for_matching(c) for c in both("name"))
    return matching.mutual_best(pairs.withColumn("score", matching.score(none, both("phone"), both("email"), name, both("city"), none)), "a_id", "b_id").select("a_id", "b_id", "score")


@query(f"WITH {_SIDES} SELECT a_id, b_id, score FROM m")
def customer_matching(spark: SparkSession, d: str) -> DataFrame:
    """Two systems' customers: blocking, scoring, mutual best match."""
    return _matches(*_sides(spark, d))


@query(f"""WITH {_SIDES}, x AS (SELECT a.a_id, b.b_id, coalesce(a.name, b.name) AS name, coalesce(b.email, a.email) AS email, CASE WHEN b.modified >= a.modified THEN b.phone ELSE a.phone END AS phone, greatest(a.modified, b.modified) AS modified, CASE WHEN b.b_id IS NULL THEN 'DMS_ONLY' ELSE 'BOTH' END AS source_presence FROM a LEFT JOIN m ON a.a_id = m.a_id LEFT JOIN b ON m.b_id = b.b_id
UNION ALL SELECT NULL, b_id, name, email, phone, modified, 'CRM_ONLY' FROM b WHERE b_id NOT IN (SELECT b_id FROM m)),
old AS (SELECT c_custkey AS a_id, c_custkey + 1 AS no FROM customer WHERE c_acctbal > 5000),
n AS (SELECT x.*, old.no, CASE WHEN old.no IS NULL THEN row_number() OVER (PARTITION BY old.no IS NULL ORDER BY x.a_id NULLS LAST, x.b_id) + (SELECT coalesce(max(no), 0) FROM old) END AS fresh FROM x LEFT JOIN old ON x.a_id = old.a_id)
SELECT 'MST' || lpad(coalesce(no, fresh)::VARCHAR, 8, '0') AS master_id, a_id, b_id, name, email, phone, modified, source_presence FROM n""")
def customer_golden(spark: SparkSession, d: str) -> DataFrame:
    """Golden records by survivorship, singletons of both systems, and master ids that stay."""
    a, b = _sides(spark, d)
    known = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("a_id"), F.lit(None).cast("long").alias("b_id"), F.concat(F.lit("MST"), F.lpad((F.col("c_custkey") + 1).cast("string"), 8, "0")).alias("master_id"))
    out = matching.stable_ids(matching.golden(_matches(a, b), a, b, "a_id", "b_id"), known, "a_id", "b_id")
    return out.select("master_id", "a_id", "b_id", "name", "email", "phone", "modified", "source_presence")


@query(f"""WITH {_SIDES}, t AS (SELECT count(*) AS n FROM b), f AS (SELECT count(*) FILTER (a_id = b_id) AS n, count(*) FILTER (a_id <> b_id) AS wrong FROM m) SELECT f.n AS tp, f.wrong AS fp, t.n - f.n AS fn, round(f.n / t.n, 6) AS recall FROM t, f""")
def matching_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of the matches against the true pairs."""
    a, b = _sides(spark, d)
    found = matching.evaluate(b.select(F.col("b_id").alias("a_id"), "b_id"), _matches(a, b), ["a_id", "b_id"])
    return found.select("tp", "fp", "fn", F.round("recall", 6).alias("recall"))
