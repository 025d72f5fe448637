"""Bounded blocks, ambiguous pairs, check digits by places, and filter trees."""

import random

import pytest
from pyspark.sql import functions as F

from lakeforge.functions import cleaning as C
from lakeforge.operators import matching, quality
from lakeforge.operators.visual_filters import context_of, literal


def test_large_blocks_grow_with_their_rows(spark):
    def sides(n):
        rows = [(i, "x" if i % 3 else f"b{i // 9}", f"n{i:06d}") for i in range(n)]
        return (spark.createDataFrame(rows, f"{s} long, block string, name string") for s in ("a", "b"))

    count = lambda n: matching.bounded_candidates(*sides(n), ["block"], "a", "b", "name", most=100, window=5).count()
    small, large = count(300), count(3000)
    assert 9 < large / small < 11
    a, b = sides(300)
    got = {tuple(r) for r in matching.bounded_candidates(a, b, ["block"], "a", "b", "name", most=100, window=5).collect()}
    everything = {tuple(r) for r in matching.candidates(a, b, ["block"], "a", "b").collect()}
    assert got < everything and {p for p in everything if p[0] % 3 == 0} <= got and {(i, i) for i in range(300)} <= got
    assert {tuple(r) for r in matching.bounded_candidates(*sides(300), ["block"], "a", "b", "name", most=10**6).collect()} == everything


def test_ambiguous_pairs(spark):
    scored = spark.createDataFrame([(1, 1, 80), (1, 2, 80), (2, 3, 90), (2, 4, 60), (3, 3, 90), (4, 5, 20), (4, 6, 20), (5, 7, 70), (6, 8, 70)], "a int, b int, score int")
    assert {(r.a, r.b) for r in matching.ambiguous(scored, "a", "b").collect()} == {(1, 1), (1, 2), (2, 3), (3, 3)}


def test_check_digits_by_places(spark):
    rng = random.Random(3)
    signs = "ABCDEFGHJKLMNPRSTUVWXYZ0123456789"
    vins = ["".join(rng.choice(signs) for _ in range(17)) for _ in range(2000)] + ["short", "I" * 17, "A" * 16 + "?", None, "1M8GDM9AXKP042788", "1M8GDM9A1KP042788"]
    df = spark.createDataFrame(list(enumerate(vins)), "id int, vin string").withColumn("flag", C.vin_check_digit_valid(F.col("vin")))
    assert quality.vin_differences(df, ["id"], "vin", "flag").count() == 0
    assert {(r.id, r.is_valid) for r in quality.vin_by_places(df, ["id"], "vin").where("id >= 2000").collect()} == {(2004, 1), (2005, 0)}
    planted = df.withColumn("flag", F.when(F.col("id") == 2004, 0).when(F.col("id") == 7, None).otherwise(F.col("flag")))
    assert {(r.id, r.stated, r.by_places) for r in quality.vin_differences(planted, ["id"], "vin", "flag").collect()} == {(2004, 0, 1), (7, None, df.where("id = 7").first().flag)}


def column(name, source="d"):
    return {"Column": {"Expression": {"SourceRef": {"Source": source}}, "Property": name}}


def value(text):
    return {"Literal": {"Value": text}}


def compared(kind, name, text):
    return {"Comparison": {"ComparisonKind": kind, "Left": column(name), "Right": value(text)}}


@pytest.mark.parametrize(
    "condition, want",
    [
        ({"In": {"Expressions": [column("b")], "Values": [[value("true")], [value("null")]]}}, {1, 2, 5}),
        ({"Not": {"Expression": {"In": {"Expressions": [column("t")], "Values": [[value("'it''s'")]]}}}}, {1, 3, 4, 5}),
        ({"In": {"Expressions": [column("t"), column("n")], "Values": [[value("'x'"), value("1L")], [value("'it''s'"), value("2L")]]}}, {1, 2}),
        (compared(0, "t", "'x'"), {1}), (compared(0, "t", "null"), {5}), (compared(1, "n", "2L"), {3, 4}), (compared(2, "n", "2L"), {2, 3, 4}), (compared(3, "v", "2.5D"), {1, 2}), (compared(4, "v", "2.5M"), {1, 2, 3}),
        (compared(2, "at", "datetime'2024-01-03T00:00:00'"), {3, 4}),
        ({"Between": {"Expression": column("n"), "LowerBound": value("2L"), "UpperBound": value("3L")}}, {2, 3}),
        ({"Contains": {"Left": column("t"), "Right": value("'T'")}}, {2, 4}), ({"StartsWith": {"Left": column("t"), "Right": value("'IT'")}}, {2}),
        ({"And": {"Left": compared(1, "n", "1L"), "Right": {"Or": {"Left": compared(0, "n", "2L"), "Right": compared(0, "n", "4L")}}}}, {2, 4}),
        ({"In": {"Expressions": [column("t")], "Values": []}}, set()),
    ],
)
def test_conditions(spark, condition, want):
    rows = spark.sql("SELECT * FROM VALUES (1, true, 'x', 1L, 1.5D, '2024-01-01'), (2, true, 'it\\'s', 2L, 2D, '2024-01-02'), (3, false, 'y', 3L, 2.5D, '2024-01-03'), (4, false, 'st', 4L, 3D, '2024-01-04'), (5, null, null, null, null, null) AS t(id, b, t, n, v, s)").withColumn("at", F.col("s").cast("timestamp_ntz"))
    context = context_of([{"filter": {"From": [{"Name": "d", "Entity": "T"}], "Where": [{"Condition": condition}]}}])
    assert {r.id for r in rows.where(context["T"]).collect()} == want


def test_filters_of_several_tables():
    one = {"filter": {"From": [{"Name": "d", "Entity": "A"}, {"Name": "e", "Entity": "B"}], "Where": [{"Condition": compared(1, "x", "1L")}, {"Condition": {"Comparison": {"ComparisonKind": 0, "Left": column("y", "e"), "Right": value("'q'")}}}]}}
    assert context_of([one, {"type": "Categorical"}, one]) == {"A": "(`x` > 1) AND (`x` > 1)", "B": "(`y` = 'q') AND (`y` = 'q')"} and context_of("[]") == {}
    with pytest.raises(ValueError, match="over"):
        context_of([{"filter": {"From": [{"Name": "d", "Entity": "A"}, {"Name": "e", "Entity": "B"}], "Where": [{"Condition": {"And": {"Left": compared(1, "x", "1L"), "Right": {"Comparison": {"ComparisonKind": 0, "Left": column("y", "e"), "Right": value("1L")}}}}}]}}])
    with pytest.raises(ValueError, match="no literal"):
        literal("1; DROP TABLE x")
