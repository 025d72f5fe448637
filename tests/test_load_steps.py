"""Narrow loads are typed in steps that compile, with check digits as plain arithmetic, and written once with what follows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakeforge.functions import cleaning as C
from lakeforge.operators import silver
from lakeforge.plans import entities, quality_queries


def test_check_digits_of_loads_are_plain_arithmetic(spark):
    vins = ["1M8GDM9AXKP042788", " 1m8gdm9axkp042788 ", "1M8GDM9A1KP042788", "wvwzzz1kz00000001", "11111111111111111", "99999999999999999", "ZZZZZZZZZZZZZZZZZ", "IOQ", "", None]
    raw = spark.createDataFrame([(f"C{i}", v, i) for i, v in enumerate(vins)], "contract_no string, vin string, _ingest_ts int").withColumn("contract_date", F.lit("1995-01-02"))
    whole = silver.load(raw, silver.CONTRACT)
    assert "zip_with" not in whole._jdf.queryExecution().executedPlan().toString()
    text = F.upper(C.clean_string(F.col("vin")))
    plain = raw.select("contract_no", C.vin_well_formed(text).cast("int"), C.vin_check_digit_valid(text))
    columns = ["contract_no", "vin_well_formed", "vin_check_digit_valid"]
    assert Counter(whole.select(*columns).collect()) == Counter(plain.collect()) == Counter(silver.load_columns(raw, silver.CONTRACT, columns).collect())
    assert whole.where("vin_check_digit_valid = 1").count() == 4


def test_what_follows_is_written_with_the_rows(spark, tmp_path):
    rows = [("R1", "1", "2.00", 1), ("R1", "1", "3.00", 1), ("R2", "1", "4.00", 1), ("R2", "1", "5.00", 2), ("R2", "01", "6.00", None), (None, None, "7.00", 1)]
    spark.createDataFrame(rows, "repair_order_no string, line_no string, line_amount string, _ingest_ts int").write.parquet(str(tmp_path / "t"))
    raw = spark.read.parquet(str(tmp_path / "t"))
    double = lambda df: df.withColumn("twice", F.col("line_amount") * 2)
    some = ["line_amount", "line_no", "part_no"]
    got = silver.load_columns(raw, silver.LINE, some, "", double)
    assert got.columns == [*some, "twice"] and Counter(got.collect()) == Counter(double(silver.load(raw, silver.LINE).select(*some)).collect())


@pytest.mark.parametrize("name", ["repair_order", "sales_contract"])
def test_steps_of_wide_loads_are_compiled(spark, monkeypatch, name):
    sizes = []

    def kept(df):
        stages = df._jdf.queryExecution().debug().codegenToSeq()
        sizes.extend(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.length()))
        return df

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        monkeypatch.setattr(silver, "stored", kept)
        silver.load_columns(entities.raw(spark, "/root/testdata/sf0.001", quality_queries._FEED[name]), silver.ENTITIES[name], quality_queries._SEEN[name], "salt")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) < 8000  # the JVM compiles no longer methods
