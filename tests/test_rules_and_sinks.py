"""Rules with faults, sinks that swap, marks and logs."""

import json

import pytest
from pyspark.sql import functions as F

from lakeforge.operators import matching, quality, rules
from lakeforge.sources import sinks
from lakeforge.sources.files import Feed, read_feed


def test_a_failing_rule_stops_no_other(spark):
    t = spark.createDataFrame([("1", "x", 1), ("2", None, 2)], "vin string, plate_masked string, model_year int")
    text = json.dumps([{"code": c, "target": "vehicle", "severity": "critical", "kind": "where", "args": {"predicate": p, "shown": ["vin"]}, "max_rate": m} for c, p, m in (("NONE", "false", 0.1), ("SOME", "vin = '1'", 0.6), ("MANY", "true", 0.6), ("BROKEN", "no_column = 1", 0.1), ("RAISES", "1 / (model_year - 1) > 0", 0.1))])
    loaded = rules.load_rules(text.replace("false", "false\t"))
    results, found = rules.evaluate({"vehicle": t}, [*loaded, rules.RuleSpec("KIND", "vehicle", "warning", "other")], "b")
    assert {r.rule_code: r.status for r in results.collect()} == {"NONE": "PASSED", "SOME": "FAILED", "MANY": "SUSPECT", "BROKEN": "ERROR", "RAISES": "ERROR", "KIND": "ERROR"}
    kept, bad = rules.quarantine(t, "vehicle", found.where("rule_code = 'SOME'"))
    assert [r.vin for r in kept.collect()] == ["2"] and [(r.vin, r.quarantine_reason) for r in bad.collect()] == [("1", "SOME")]
    assert rules.summary(results).where("severity = 'critical'").first().asDict() == {"batch_id": "b", "severity": "critical", "rules": 5, "passed": 1, "failed": 1, "suspect": 1, "error": 2, "rows_evaluated": 10, "rows_violated": 3}
    empty, _ = rules.evaluate({"vehicle": t.where("false")}, loaded[:3], "b")
    assert {r.status for r in empty.collect()} == {"PASSED"}
    with pytest.raises(ValueError, match="no rules"):
        rules.load_rules("[]")


def test_upserts_swap_and_count(spark, tmp_path):
    path = str(tmp_path / "t")
    row = lambda *x: spark.createDataFrame(x, "k int, v string, _row_hash string")
    assert sinks.merge_into(row((1, "a", "a"), (2, "b", "b")), path, ["k"]) == {"created": True, "rows": 2, "inserted": 2, "updated": 0}
    assert sinks.merge_into(row((1, "a", "a"), (2, "c", "c"), (3, "d", "d")), path, ["k"]) == {"created": False, "rows": 3, "inserted": 1, "updated": 1}
    assert sinks.merge_into(row((1, "a", "a")), path, ["k"]) == {"created": False, "rows": 3, "inserted": 0, "updated": 0}
    assert {(r.k, r.v) for r in sinks.read_table(spark, path).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    with pytest.raises(ValueError, match="1 keys are repeated"):
        sinks.merge_into(row((4, "a", "a"), (4, "b", "b")), path, ["k"])
    assert sinks.merge_into(row((4, "a", "a"), (4, "b", "b")), path, ["k"], order="v")["inserted"] == 1
    sinks.overwrite(sinks.read_table(spark, path).where("k > 1"), path)
    assert {(r.k, r.v) for r in sinks.read_table(spark, path).collect()} == {(2, "c"), (3, "d"), (4, "b")}
    path = str(tmp_path / "u")
    sinks.overwrite(spark.range(1000).repartition(8), path)
    got = sinks.compact(spark, path, "id")
    assert got["before"]["files"] == 8 and got["after"]["files"] == 1 and got["before"]["rows"] == got["after"]["rows"] == 1000
    assert {p.name for p in tmp_path.iterdir()} == {"t", "u"}


def test_quarantine_adds_batches(spark, tmp_path):
    bad = spark.createDataFrame([("1", "R"), ("2", "R, S")], "vin string, quarantine_reason string")
    path = str(tmp_path / "q")
    assert sinks.append_quarantine(bad, path, "vin", "b1") == 2
    assert sinks.append_quarantine(bad.withColumn("more", F.lit(1)), path, "vin", "b2") == 2
    assert sinks.append_quarantine(bad.where("vin = '1'"), path, "vin", "b1") == 1
    assert {(r._batch_id, r._business_key, r._quarantine_reason, r.more) for r in sinks.read_table(spark, path).collect()} == {("b1", "1", "R", None), ("b2", "1", "R", 1), ("b2", "2", "R, S", 1)}


def test_marks_of_mixed_formats(spark, tmp_path):
    df = spark.createDataFrame([("05.03.2024",), ("2024-02-01",), ("",), ("2023-12-31 23:00:00",)], "at string")
    assert sinks.high_water(df, "at") == "2024-03-05 00:00:00"
    assert sinks.high_water(df, None, ["/x/2024-01-01", "/x/2024-01-02/"]) == "2024-01-02" and sinks.high_water(df, None) is None
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("at\n05.03.2024\n2024-02-01\n31/12/2023\n")
    feed = Feed("f", "s", str(tmp_path / "in"), watermark_column="at")
    assert {r["at"] for r in read_feed(spark, feed, "2024-01-15").collect()} == {"05.03.2024", "2024-02-01"}


def test_a_failed_step_is_logged_and_raised(spark, tmp_path):
    log = str(tmp_path / "log")
    assert sinks.run_steps(spark, "1", [("a", lambda: {"rows_read": 3, "rows_written": 2}), ("b", lambda: None)], log).count() == 2
    with pytest.raises(ZeroDivisionError):
        sinks.run_steps(spark, "2", [("a", lambda: 1 / 0), ("b", lambda: None)], log)
    assert {(r.batch_id, r.steps, r.status) for r in quality.reconcile(spark.read.parquet(log)).collect()} == {("1", 2, "SUCCEEDED"), ("2", 1, "FAILED")}


def test_large_blocks_are_reported(spark):
    shape = "id int, full_name string, identity_no string, phone string, email string, city string"
    people = spark.createDataFrame([(i, f"P{i} X LTD", None, "0 555 111 22 33", None, None) for i in range(5)], shape)
    a, b = matching.standardise(people, "id", "a", "s"), matching.standardise(people, "id", "b", "s")
    assert [(r.block, r.value, r.n_left) for r in matching.oversized_blocks(a, b, "a", "b", 20).collect()] == [("phone", "5551112233", 5)]
    assert matching.blocked(a, b, "a", "b").count() == 25 and {r.a_name for r in a.collect()} == {f"P{i} X" for i in range(5)}
    truth = spark.createDataFrame([(1, 1, "EASY"), (2, 2, "HARD")], "a int, b int, kind string")
    assert {(r.kind, r.missed) for r in matching.evaluate_by(truth, truth.where("a = 1").select("a", "b"), ["a", "b"], "kind").collect()} == {("EASY", 0), ("HARD", 1)}


def test_quarantine_meets_keys_part_by_part(spark):
    t = spark.createDataFrame([("a#b", "c", -1.0), ("a", "b#c", 1.0), (None, "1", -1.0), ("1", None, 1.0), ("1", "1", 5.0)], "repair_order_no string, line_no string, labour_hours double")
    rule = rules.RuleSpec("NEGATIVE", "repair_order_line", "critical", "where", {"predicate": "labour_hours < 0", "shown": ["labour_hours"]})
    _, found = rules.evaluate({"repair_order_line": t}, [rule], "b")
    kept, bad = rules.quarantine(t, "repair_order_line", found)
    assert {(r.repair_order_no, r.line_no) for r in bad.collect()} == {("a#b", "c"), (None, "1")}
    assert kept.count() == 3


def test_rules_of_rows_read_their_target_once(spark, tmp_path):
    path = f"file://{tmp_path}/lines"
    spark.range(10).selectExpr("cast(id as string) repair_order_no", "1 line_no", "id - 5.0 labour_hours").write.parquet(path)
    specs = {i: rules.RuleSpec(f"R{i}", "repair_order_line", "warning", "where", {"predicate": f"labour_hours > {i}", "shown": ["labour_hours"]}) for i in range(4)}
    scan = rules._row_rules(specs, spark.read.parquet(path))
    assert scan._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert sorted((r._rule, r.business_key) for r in scan.collect()) == sorted((i, f"{k}#1") for i in range(4) for k in range(10) if k - 5 > i)
