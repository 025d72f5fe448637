"""Typing and shuffles: work that must grow with the rows."""

import datetime as dt

from pyspark.sql import functions as F

from lakeforge.functions import cleaning as C
from lakeforge.operators import silver
from lakeforge.plans import entities


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_check_digits_name_their_text_once(spark):
    df = spark.createDataFrame([("wvwzzz1kz00000001",), ("1M8GDM9AXKP042788",), ("IOQ",), (None,), ("",)], "v string").select(C.vin_check_digit(F.col("v")).alias("d"), C.vin_check_digit_valid(F.col("v")).alias("ok"))
    assert [(r.d, r.ok) for r in df.collect()] == [("9", 0), ("X", 1), (None, None), (None, None), (None, None)]
    assert _plan(df.select("d")).count("translate(") == 1


def test_texts_of_another_shape_are_not_tried(spark):
    texts = ["1995-01-02", "1995-01-02 03:04:05", "1995-01-02t03:04:05", "02.01.1995", "2.1.1995", "99.99.2024", "+1995-01-02", " 1995-01-02", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = lambda parse, formats: F.coalesce(*(parse(F.col("t"), f) for f in formats))
    dates, times = plain(F.try_to_date, C.DATE_FORMATS), plain(lambda c, f: F.try_to_timestamp(c, F.lit(f)), C.TIMESTAMP_FORMATS)
    got = df.select(C.parse_date(F.col("t")).alias("a"), dates.alias("b"), C.parse_timestamp(F.col("t")).alias("c"), times.alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in got) and got[3].a == dt.date(1995, 1, 2) and got[5].a is None
    assert "RLIKE" in _plan(df.select(C.parse_timestamp(F.col("t")))).upper()
    assert C.parse_date(F.lit("2 Jan 1995"), ("d MMM yyyy",)) is not None and C._shape("d MMM yyyy") is None


def test_rows_are_shuffled_without_their_hashes(spark, tmp_path):
    shape = "repair_order_no string, line_no string, line_amount string, _ingest_ts int"
    spark.createDataFrame([("R1", "1", "2.00", 1), ("R1", "1", "3.00", 1), ("R1", "1", "9.00", 0)], shape).write.parquet(str(tmp_path / "t"))
    df = silver.load(spark.read.parquet(str(tmp_path / "t")), silver.LINE)
    plan = _plan(df)
    assert plan.count("Exchange") == 1 and plan.rindex("sha2") < plan.index("Exchange") and plan.rindex("Sort ") < plan.index("Exchange")
    assert df.count() == 1


def test_purchase_measures_join_no_dimension(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("no dimension is needed")

    for name in ("_purchase_facts", "_parts", "_suppliers"):
        monkeypatch.setattr(entities, name, refuse)
    assert entities.purchase_measures(spark, "/root/testdata/sf0.001").count() > 0
