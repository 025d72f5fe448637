"""Surrogate keys on wide rows, promoted members, special members."""

import datetime

import pytest
from pyspark.sql import functions as F

from lakeforge.functions import cleaning as C
from lakeforge.operators import scd2


@pytest.mark.parametrize(("n", "parts", "adaptive"), [(200_000, 4, True), (200_000, 200, True), (200_000, 64, False), (1_000_000, 200, True)])
def test_keys_have_no_gaps_or_repeats(spark, n, parts, adaptive):
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", str(adaptive).lower())
    try:
        rows = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(10**15)).alias("k"), *(F.concat(F.lit("x" * 40), F.col("id").cast("string")).alias(f"c{i}") for i in range(3)))
        out = scd2.with_surrogate(rows, ["k"], "sk")
        got = out.agg(F.count("*"), F.countDistinct("sk"), F.min("sk"), F.max("sk"), F.countDistinct("c0")).first()
        assert tuple(got) == (n, n, 1, n, n)
        ordered = out.select("sk", "k").join(out.select((F.col("sk") - 1).alias("sk"), F.col("k").alias("next")), "sk")
        assert ordered.where("next < k").isEmpty()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_inferred_members_are_filled_in_place(spark):
    day = datetime.date
    known = spark.createDataFrame([("a", "1", day(2020, 1, 1), 7)], "k string, v string, at date, i int")
    dim = scd2.load_dimension(known, "k", ["v"], "at", "i", "sk")
    late = scd2.inferred_members([spark.createDataFrame([("b", day(2020, 3, 1)), ("b", day(2020, 2, 1)), ("a", day(2019, 1, 1))], "k string, seen date")], dim, "k")
    dim = dim.unionByName(scd2.with_surrogate(late, ["k"], "sk", start=1).drop("status"), allowMissingColumns=True)
    new = spark.createDataFrame([("a", "1", None), ("b", "2", None), ("c", "3", day(2018, 5, 5)), ("d", "4", None)], "k string, v string, since date")
    out = scd2.apply_changes(dim, new, "k", ["v"], "2021-01-01", since="since", sk="sk")
    got = {(r.k, r.sk, r.v, str(r.valid_from), str(r.valid_to), r.is_current, r.is_inferred) for r in out.collect()}
    end = "9999-12-31"
    assert got == {
        ("a", 1, "1", "2020-01-01", end, True, False), ("b", 2, "2", "2020-02-01", end, True, False), ("c", 3, "3", "2018-05-05", end, True, False),
        ("d", 4, "4", "2021-01-01", end, True, False), ("-1", -1, None, "1900-01-01", end, True, False), ("-2", -2, None, "1900-01-01", end, True, False),
    }
    assert scd2.load_dimension(known, "k", ["v"], "at", "i", "sk", existing=dim).count() == dim.count()


def test_owners_are_spread_over_their_versions(spark):
    rows = [("v", 1, None), ("v", 2, "x"), ("v", 3, "x"), ("v", 4, "y"), ("w", 1, "z")]
    out = scd2.owner_since(spark.createDataFrame(rows, "vin string, at int, owner string"), "vin", "owner", "at").collect()
    assert {(r.vin, r.at, r.owner_since_date) for r in out} == {("v", 1, None), ("v", 2, 2), ("v", 3, 2), ("v", 4, 4), ("w", 1, 1)}


def test_cleaning_values(spark):
    text = lambda f, *xs: [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, c string").orderBy("i").select(f(F.col("c"))).collect()]
    assert text(C.strip_company_suffix, "ACME SAN VE TIC A S", "ACME AS LTD", "ACME LTD STI", "ACME") == ["ACME", "ACME AS", "ACME", "ACME"]
    assert text(C.mask_plate, " 34 ABC 12 ", "34", None) == ["34 *** 12", None, None]
    assert text(C.mask_email, " a@b.c ", "ab") == ["a***@b.c", None]
    assert text(C.mask_identity_no, " 12345678 ", "1234567") == ["123*****678", None]
    assert text(C.normalise_for_matching, "Işık  Öz-Ltd", "âbc") == ["ISIK OZ LTD", "BC"]
    assert text(lambda c: C.week_start(c.cast("date")).cast("string"), "2024-03-03", "2024-03-04") == ["2024-02-26", "2024-03-04"]
    assert text(lambda c: C.quarter_label(c.cast("date")), "2024-03-03") == ["2024-Q1"]


def test_changed_attributes_name_what_started_a_version(spark):
    rows = [("a", "1990-01-01", "x", 1), ("a", "1991-01-01", "x", 2), ("a", "1992-01-01", None, 3), ("a", "1993-01-01", None, 3), ("b", "1990-01-01", None, None)]
    versions = scd2.backfill(spark.createDataFrame([(*r, 1) for r in rows], "k string, seen string, t string, n int, _ingest_ts int"), "k", ["t", "n"], "seen", "_ingest_ts")
    got = [(r.k, str(r.valid_from), r.changed) for r in scd2.changed_attributes(versions, "k", ["t", "n"]).orderBy("k", "valid_from").collect()]
    assert got == [("a", "1990-01-01", None), ("a", "1991-01-01", ["n"]), ("a", "1992-01-01", ["t", "n"]), ("b", "1990-01-01", None)]
