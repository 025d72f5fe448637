"""Rows are dealt out by their number, so that no task sorts more than it can hold."""

from lakeforge.operators import facts, keys, rules, silver
from lakeforge.plans import entities, model_queries


def _refuse(*_):
    raise AssertionError("whole entities and facts are not needed")


def test_loads_deal_rows_out_by_their_number(spark, monkeypatch):
    raw = spark.createDataFrame([(f"R{i}", "1", "2.00", i) for i in range(100)], "repair_order_no string, line_no string, line_amount string, _ingest_ts int")
    tasks = []
    monkeypatch.setattr(keys, "TASK_ROWS", 10)
    monkeypatch.setattr(silver, "stored", lambda df: tasks.append(df.rdd.getNumPartitions()) or df)
    silver.load_columns(raw, silver.LINE, ["line_amount"])
    tasks.append(silver.load(raw, silver.LINE).rdd.getNumPartitions())
    assert min(tasks) > 10  # the session has 4 shuffle partitions


def test_few_rows_are_dealt_to_few_tasks(spark):
    assert keys.dealt(spark.range(10), "id").rdd.getNumPartitions() == 1
    assert keys.dealt(spark.range(10), "id", rows=keys.TASK_ROWS * 9).rdd.getNumPartitions() == 10


def test_quarantine_is_counted_by_keys_alone(spark, monkeypatch):
    t = spark.createDataFrame([("a#b", "c", -1.0), ("a", "b#c", 1.0), (None, "1", -1.0), (None, "1", 2.0), ("1", None, 1.0), ("1", "1", 500.0)], "repair_order_no string, line_no string, labour_hours double")
    some = [r for r in rules.RULES if r.code.startswith("LABOUR_HOURS")]
    found = rules.evaluate({"repair_order_line": t}, some, "b")[1]
    kept, bad = rules.quarantine(t, "repair_order_line", found)
    want = {"": kept.count()} | {r.quarantine_reason: r["count"] for r in bad.groupBy("quarantine_reason").count().collect()}
    sizes = rules.quarantine_sizes(t, "repair_order_line", found)
    assert {r.quarantine_reason: r.n for r in sizes.collect()} == want == {"": 3, "LABOUR_HOURS_NEGATIVE": 3}
    plan = sizes._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_orphans_are_told_by_values(spark, monkeypatch):
    lines = spark.createDataFrame([(f"R{i}", 1, "PART", f"P{i % 7}" if i % 5 else None) for i in range(100)], "repair_order_no string, line_no int, line_type string, part_no string")
    tables = {"repair_order_line": lines, "part": spark.createDataFrame([("P1",), ("P1",), ("P2",), (None,)], "part_no string")}
    rule = next(r for r in rules.RULES if r.code == "PART_NO_ORPHAN" and r.target == "repair_order_line")
    want = {f"R{i}#1" for i in range(100) if i % 5 and i % 7 not in (1, 2)}
    for few in (100, 1):
        monkeypatch.setattr(keys, "FEW_KEYS", few)
        got = rules.violations(rule, tables)
        assert {r.business_key for r in got.collect()} == want
        assert ("BroadcastHashJoin" in (plan := got._jdf.queryExecution().executedPlan().toString())) == (few == 100) and "SortMergeJoin" not in plan


def test_only_what_is_asked_of_violations_is_written(spark, monkeypatch):
    t = spark.createDataFrame([("R1", 1, -1.0), ("R2", 1, 2.0)], "repair_order_no string, line_no int, labour_hours double")
    some = [r for r in rules.RULES if r.code == "LABOUR_HOURS_NEGATIVE"]
    written = []
    monkeypatch.setattr(rules, "stored", lambda df: written.append(df.columns) or df)
    results, found = rules.evaluate({"repair_order_line": t}, some, "b", ("business_key",))
    assert written == [["business_key", "_rule"]] and found.select("business_key").collect() == [("R1#1",)]
    assert results.first().rows_violated == 1


def test_targets_need_no_whole_fact(spark, monkeypatch):
    for name in ("_orders", "_contracts", "_sales", "_order_facts", "_dim_vehicle", "_dealers", "_customers"):
        monkeypatch.setattr(entities, name, _refuse)
    assert entities.agg_monthly_targets(spark, "/root/testdata/sf0.001").count() > 0


def test_facts_of_sales_need_no_whole_entity(spark, monkeypatch):
    monkeypatch.setattr(entities, "_BUILT", {})
    for name in ("_orders", "_contracts", "_vehicles"):
        monkeypatch.setattr(entities, name, _refuse)
    assert entities.fact_vehicle_sale(spark, "/root/testdata/sf0.001").count() == 1500


def test_measures_across_facts_need_no_whole_fact(spark, monkeypatch):
    monkeypatch.setattr(entities, "_BUILT", {})
    for name in ("_orders", "_contracts", "_lines", "_sales", "_order_facts"):
        monkeypatch.setattr(entities, name, _refuse)
    assert model_queries.cross_fact_measures(spark, "/root/testdata/sf0.001").count() > 0


def test_keys_and_days_are_looked_up_once(spark, monkeypatch):
    dim = spark.createDataFrame([(1, "A", "1990-01-01", "1995-01-01"), (2, "A", "1995-01-01", "9999-12-31"), (-1, "-1", "1900-01-01", "9999-12-31")], "sk long, code string, f string, t string").selectExpr("sk", "code", "date(f) valid_from", "date(t) valid_to")
    fact = spark.createDataFrame([(i, "A" if i % 3 else None if i % 2 else "B", f"199{i % 9}-06-01") for i in range(30)], "id int, code string, day string").selectExpr("id", "code", "date(day) day")
    want = {(r.id, r.sk) for r in keys.lookup_as_of(fact, dim, "sk", "code", "code", "day").collect()}
    for few in (1, 100):
        monkeypatch.setattr(keys, "FEW_KEYS", few)
        got = keys.lookup_by_day(fact, dim, "sk", "code", "code", "day", fact)
        assert {(r.id, r.sk) for r in got.collect()} == want and got.count() == 30 and got.columns == ["id", "code", "day", "sk"]


def test_lines_without_a_part_look_none_up(spark):
    lines = spark.createDataFrame([("R1", 1, "LABOUR", None), ("R1", 2, "PART", "P1"), ("R1", 3, "PART", None), ("R1", 4, None, "P1"), ("R1", 5, "LABOUR", "P1"), ("R1", 6, "PART", "P9")], "repair_order_no string, line_no int, line_type string, part_no string")
    orders = spark.sql("select 'R1' repair_order_no, date'1995-01-01' checkin_date, 7L dealer_sk")
    part = spark.sql("select 'P1' part_no, 5L part_sk, date'1990-01-01' valid_from, date'9999-12-31' valid_to")
    got = facts.repair_order_line(lines, orders, {"part": part})
    assert {r.line_no: r.part_sk for r in got.collect()} == {1: -2, 2: 5, 3: -1, 4: 5, 5: -2, 6: -1}
    assert "isnotnull(part_no" in got._jdf.queryExecution().optimizedPlan().toString()
