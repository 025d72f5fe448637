"""Paths of relationships and contexts; loads that resume."""

import pytest
from pyspark.sql import functions as F

from lakeforge.operators.model import STAR, AmbiguousPath, Kept, Measure, Model, Relation, star
from lakeforge.plans import model_queries
from lakeforge.sources import loads
from lakeforge.sources.loads import Cycle, Load, Step

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    df = spark.createDataFrame
    tables = {
        "Sale": df([(1, 10, 1, 5, 100), (1, 11, 2, 6, 10), (2, None, 1, 7, 1), (9, 10, None, 5, 1000)], "d int, e int, c int, v int, x int"),
        "Visit": df([(1, 5), (2, 5), (2, 8), (3, 6)], "d int, v int"),
        "Date": df([(1, "a"), (2, "a"), (10, "b"), (11, "c"), (3, "c")], "day int, month string"),
        "Customer": df([(1, 1), (2, 2)], "c int, p int"),
        "Province": df([(1, "north"), (2, "south")], "p int, name string"),
    }
    relations = [Relation("Sale", "Date", "d", "day"), Relation("Sale", "Date", "e", "day", active=False), Relation("Visit", "Date", "d", "day"), Relation("Sale", "Customer", "c", "c"), Relation("Customer", "Province", "p", "p")]
    return Model(tables, relations)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def amount(spark):
    return Measure("Sale", F.sum("x"))


def test_roles_of_a_date(model, amount):
    out = model.evaluate({"made": amount, "ended": amount.by("e")}, ["Date.month"])
    assert rows(out) == sorted([("a", 111, None), ("b", None, 1100), ("c", None, 10), (None, 1000, 1)], key=str)


def test_a_context_reaches_only_what_leads_to_it(model, amount):
    north = {"Province": "name = 'north'"}
    visits = Measure("Visit", F.count(F.lit(1)))
    assert rows(model.evaluate({"x": amount, "visits": visits}, [], north)) == [(101, 4)]
    assert rows(model.evaluate({"x": amount, "all": Measure("Sale", F.sum("x"), without=("Province",))}, ["Date.month"], north)) == sorted([("a", 101, 111), (None, None, 1000)], key=str)
    assert rows(model.evaluate({"x": amount, "visits": visits}, ["Province.name"], {"Date": "month = 'a'"})) == [("north", 101, 3), ("south", 10, 3)]
    only = Measure("Sale", F.sum("x"), where={"Customer": "c = 2", "Sale": "x > 5"})
    assert rows(model.evaluate({"x": only}, [])) == [(10,)]


def test_values_that_come_again(model, amount):
    kept = Kept(Measure("Sale", F.col("v"), without=("Date",)), Measure("Visit", F.col("v"), without=("Sale",)))
    got = model.evaluate({"k": kept}, [], {"Date": "month = 'a'", "Sale": "x > 0"}).first().k
    assert (got.retained, got.base, round(got.rate, 3)) == (1, 3, 0.333)


def test_what_is_ambiguous_or_unknown_raises(spark, model, amount):
    extra = [*model.relations, Relation("Sale", "Province", "v", "p")]
    with pytest.raises(AmbiguousPath, match=r"Customer\[c\] > Province\[p\] and by Province\[v\]"):
        Model(model.tables, extra).evaluate({"x": amount}, ["Province.name"])
    with pytest.raises(ValueError, match="more than one active"):
        Model(model.tables, [*model.relations, Relation("Sale", "Date", "v", "day")])
    with pytest.raises(ValueError, match="no column"):
        Model(model.tables, [Relation("Sale", "Date", "nothing", "day")])
    with pytest.raises(ValueError, match="share no rows"):
        model.evaluate({"x": amount, "v": Measure("Visit", F.count("*")), "p": Measure("Customer", F.count("*"))}, ["Sale.v", "Visit.d"])


def test_who_may_see_a_province_sees_what_lies_there(spark, model, amount):
    mine = model.secured("Province", spark.createDataFrame([(1,)], "p int"))
    assert {n: df.count() for n, df in mine.tables.items()} == {"Sale": 2, "Visit": 4, "Date": 5, "Customer": 1, "Province": 1}
    assert rows(mine.evaluate({"x": amount}, [])) == [(101,)]
    assert model.secured("Province", spark.createDataFrame([], "p int")).tables["Sale"].count() == 0


def test_the_star_has_its_relationships():
    assert sum(r.active for r in STAR) == 33 and sum(not r.active for r in STAR) == 8
    m = Model({}, STAR)
    assert [r.key for r in m.path("Vehicle Sale", "Date", ("registration_date_key",))] == ["registration_date_key"]
    assert m.path("Date", "Vehicle Sale") is None and m.path("Part Purchase", "Dealer") is None
    with pytest.raises(AmbiguousPath):
        m.path("Vehicle Sale", "Province")
    assert star({}).relations == []


def test_order_and_cycles(spark, tmp_path):
    make = lambda t: spark.range(1)
    load = Load(spark, str(tmp_path), [Step("c", make, ("b", "a")), Step("b", make, ("a",)), Step("a", make), Step("z", make)])
    assert load.order() == ["a", "b", "c", "z"]
    with pytest.raises(Cycle, match="'a', 'b'"):
        Load(spark, str(tmp_path), [Step("a", make, ("b",)), Step("b", make, ("a",))]).order()
    with pytest.raises(ValueError, match="no step makes"):
        Load(spark, str(tmp_path), [Step("a", make, ("q",))])


def test_a_run_resumes_where_it_failed(spark, tmp_path):
    calls, broken = [], [True]

    def make(name, df):
        def run(t):
            calls.append(name)
            if name == "c" and broken:
                raise broken[0] if isinstance(broken[0], BaseException) else OSError("the disk is full")
            return df(t)

        return run

    steps = [Step("a", make("a", lambda t: spark.range(5))), Step("b", make("b", lambda t: (t["a"].where("id > 1"), {"rows_rejected": 2})), ("a",)), Step("c", make("c", lambda t: t["b"].unionByName(t["a"])), ("a", "b"))]
    load = Load(spark, str(tmp_path), steps)
    with pytest.raises(OSError):
        load.run("1")
    assert calls == ["a", "b", "c"] and load.done("1") == {"a", "b"}
    assert {(r.status, r.error_message) for r in loads.latest(load.log.read()).where("step_name = 'BATCH'").collect()} == {("FAILED", "1 step(s) failed")}
    broken[0] = KeyboardInterrupt()  # the driver dies: nobody writes how the step ended
    with pytest.raises(KeyboardInterrupt):
        load.run("1")
    broken.clear()
    again = Load(spark, str(tmp_path), steps)
    assert again.run("1") == {"a": "kept", "b": "kept", "c": "made"} and calls == ["a", "b", "c", "c", "c"]
    assert again.table("c").read().count() == 8
    log = loads.latest(again.log.read())
    assert {(r.step_name, r.status, r.rows_read, r.rows_written, r.rows_rejected) for r in log.collect()} == {("BATCH", "SUCCEEDED", 13, 16, 2), ("a", "SUCCEEDED", 0, 5, 0), ("b", "SUCCEEDED", 5, 3, 2), ("c", "SUCCEEDED", 8, 8, 0)}
    assert again.run("2") == dict.fromkeys("abc", "made") and again.table("a").history().count() == 2
    got = loads.reconciliation(log.where("step_name != 'BATCH'")).first()
    assert (got.step_count, got.failed_steps, got.unexplained_row_gap) == (3, 0, -5) and got.batch_start_ts < got.batch_end_ts


def test_the_star_is_the_same_after_a_failure(spark, tmp_path, monkeypatch):
    whole = model_queries.star_load(spark, FOLDER, str(tmp_path / "whole"))
    whole.run("b")
    cut = model_queries.star_load(spark, FOLDER, str(tmp_path / "cut"))
    with monkeypatch.context() as m:
        m.setattr(model_queries.facts, "repair_order_line", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            cut.run("b")
    again = model_queries.star_load(spark, FOLDER, str(tmp_path / "cut")).run("b")
    assert again["fact_repair_order"] == "kept" and again["fact_repair_order_line"] == "made"
    for name in ("dim_part", "fact_vehicle_sale", "fact_repair_order_line", "agg_monthly_service"):
        a, b = whole.table(name).read(), cut.table(name).read()
        assert a.count() > 0 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), name
    lines = whole.table("fact_repair_order_line").read()
    assert lines.where("part_sk = -1 and part_no is not null and part_no <> ''").count() == 0
    assert whole.table("dim_part").read().where("is_inferred").count() > 0
