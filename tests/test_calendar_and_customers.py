"""Holidays, the calendar's roles, provinces, inferred members in facts, survivorship of twelve attributes, answer keys."""

import datetime as dt

from lakeforge.operators import calendar, matching, provinces, scd2
from lakeforge.operators.keys import lookup_as_of
from lakeforge.sources.files import read_answer_key

DAY = dt.date.fromisoformat


def test_holidays_and_working_days(spark):
    rows = {r.full_date: r for r in calendar.dim_date(spark, "2023-01-01", "2024-12-31").collect()}
    assert len(rows) == 365 + 366 + 1
    assert rows[DAY("2023-04-23")].holiday_name == "Ramazan Bayramı"  # two whole holidays on one day: one row, the smaller name
    assert rows[DAY("2024-10-28")].is_half_day == 1 and rows[DAY("2024-10-28")].is_working_day == 1 and rows[DAY("2024-10-28")].is_public_holiday == 0
    assert rows[DAY("2024-04-09")].holiday_name == "Ramazan Bayramı Arifesi" and rows[DAY("2024-04-09")].is_working_day == 1
    assert [rows[DAY(f"2024-04-{d:02}")].is_working_day for d in range(8, 16)] == [1, 1, 0, 0, 0, 0, 0, 1]
    assert rows[DAY("2024-02-29")].same_date_last_year_key == 20230228 and rows[DAY("2023-06-01")].same_date_last_year_key is None
    first = rows[DAY("2023-01-01")]
    assert (first.iso_year, first.iso_week, first.day_of_week, first.week_start_date, first.quarter_label) == (2022, 52, 7, DAY("2022-12-26"), "2023-Q1")
    unknown = rows[DAY("1900-01-01")]
    assert unknown.date_key == -1 and unknown.month_key == 0 and unknown.holiday_name is None and unknown.quarter_label == "Unknown"


def test_a_whole_day_beats_a_half_day_and_years_without_feasts_have_none(spark):
    marks = spark.createDataFrame([(DAY("2031-03-03"), "b", 0)], "holiday_date date, holiday_name string, is_half_day int")
    days = {r.full_date: r for r in calendar.dim_date(spark, "2031-03-01", "2031-03-05", marks).collect()}
    assert days[DAY("2031-03-03")].is_public_holiday == 1 and days[DAY("2031-03-04")].is_public_holiday == 0
    assert {r.holiday_date.strftime("%m-%d") for r in calendar.holidays(spark, "2031-01-01", "2031-12-31").collect()} == {"01-01", "04-23", "05-01", "05-19", "07-15", "08-30", "10-28", "10-29"}


def test_roles_and_current_versions(spark):
    role = calendar.as_role(calendar.dim_date(spark, "2024-01-01", "2024-01-02"), "delivery")
    assert role.columns == ["delivery_date_key", "delivery_date", "delivery_month", "delivery_quarter", "delivery_year"]
    dim = spark.createDataFrame([(1, "a", DAY("2024-01-01"), DAY("2024-02-01"), False, "x"), (2, "a", DAY("2024-02-01"), DAY("9999-12-31"), True, "y"), (-1, "-1", DAY("1900-01-01"), DAY("9999-12-31"), True, None)], "sk int, k string, valid_from date, valid_to date, is_current boolean, _row_hash string")
    assert sorted(map(tuple, calendar.current(dim).collect())) == [(-1, "-1"), (2, "a")]


def test_provinces(spark):
    assert provinces.provinces(spark).count() == 82
    codes = spark.createDataFrame([("34",), ("01",), ("1",), ("99",), ("-1",), (None,), ("",)], "code string")
    got = {r.code: r.region for r in provinces.with_region(codes, "code").collect()}
    assert got == {"34": "Marmara", "01": "Akdeniz", "1": None, "99": None, "-1": "Bilinmiyor", None: None, "": None}
    assert {r.region for r in provinces.with_region(codes, "code", unknown=True).where("code is null or code = '99'").collect()} == {"Bilinmiyor"}


def test_facts_find_the_members_that_they_made_known(spark):
    snapshots = spark.createDataFrame([("a", "x", "2024-01-05", 1)], "k string, v string, observed string, n int")
    dim = scd2.load_dimension(snapshots, "k", ["v"], "observed", "n", "sk")
    facts = spark.createDataFrame([(1, "a", DAY("2024-01-09")), (2, "a", DAY("2024-01-01")), (3, "c", DAY("2024-01-07")), (4, "c", DAY("2024-01-03")), (5, "b", DAY("2024-01-02")), (6, None, DAY("2024-01-02"))], "id int, k string, day date")
    whole = scd2.with_inferred(dim, [facts.selectExpr("k", "day as seen")], "k", "sk")
    keys = {r.id: r.sk for r in lookup_as_of(facts, whole, "sk", "k", "k", "day").collect()}
    assert keys == {1: 1, 2: -1, 3: 3, 4: 3, 5: 2, 6: -1}  # b and c get the next keys; a before its first version stays unknown
    new = {r.k: r for r in whole.where("is_inferred").collect()}
    assert new["c"].valid_from == DAY("2024-01-03") and new["c"].v is None and new["c"]._row_hash is None and new["c"].status == "UNKNOWN"
    assert scd2.with_inferred(whole, [facts.selectExpr("k", "day as seen")], "k", "sk").count() == whole.count()
    # the source names c later: it is filled in place and keeps its key
    source = spark.createDataFrame([("c", "z")], "k string, v string")
    later = scd2.apply_changes(whole, source, "k", ["v"], "2024-02-01", sk="sk").where("k = 'c'").collect()
    assert [(r.sk, r.v, r.is_inferred) for r in later] == [(3, "z", False)]


SIDE = "id int, customer_type string, identity_no string, full_name string, email string, phone string, city string, city_code string, address_line string, lead_source string, consent boolean, customer_since date, modified timestamp"


def _person(i, tag, modified, name="Ada", **values):
    base = {"customer_type": tag, "identity_no": tag, "full_name": name, "email": tag, "phone": tag, "city": tag, "city_code": tag, "address_line": tag, "lead_source": tag, "consent": tag == "r", "customer_since": DAY("2020-01-01"), "modified": modified}
    return (i, *(base | values).values())


def test_every_attribute_survives_by_its_rule(spark):
    old, new = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    left = spark.createDataFrame([_person(1, "l", old), _person(2, "l", new, "Şule", identity_no=None), _person(3, "l", None, email="own"), _person(4, "l", old)], SIDE).withColumnRenamed("id", "lid")
    right = spark.createDataFrame([_person(11, "r", new, "Adaa"), _person(12, "r", old, "Sule", email=None), _person(13, "r", new), _person(14, "r", old)], SIDE).withColumnRenamed("id", "rid")
    pairs = spark.createDataFrame([(1, 11, 70), (2, 12, 60), (3, 13, 55)], "lid int, rid int, match_score int")
    got = {(r.lid, r.rid): r for r in matching.survive(pairs, left, right, "lid", "rid").collect()}
    assert set(got) == {(1, 11), (2, 12), (3, 13), (4, None), (None, 14)}
    a, b, c, single_l, single_r = (got[k] for k in ((1, 11), (2, 12), (3, 13), (4, None), (None, 14)))
    assert (a.customer_type, a.identity_no, a.full_name, a.email, a.phone, a.city, a.city_code, a.address_line, a.lead_source, a.consent, a.modified, a.source_presence, a.match_score) == ("l", "l", "Adaa", "r", "r", "r", "l", "l", "r", True, new, "BOTH", 70)
    assert (b.identity_no, b.full_name, b.email, b.phone, b.city) == ("r", "Şule", "l", "l", "l")  # richer by its letter; the left changed later
    assert (c.phone, c.email, c.modified) == ("l", "r", new)  # a missing time leaves the left side's
    assert (single_l.lead_source, single_l.consent, single_l.phone, single_l.source_presence, single_l.match_score) == (None, None, "l", "DMS_ONLY", 0)
    assert (single_r.city_code, single_r.address_line, single_r.customer_since, single_r.customer_type, single_r.phone, single_r.source_presence) == (None, None, None, "r", "r", "CRM_ONLY")
    assert matching.survive(pairs, left.limit(0), right.limit(0), "lid", "rid").count() == 0


def test_answer_key_and_what_was_missed(spark, tmp_path):
    (tmp_path / "key.csv").write_text("dms,crm,match_difficulty\nD1,C1,easy\nD2,C2,hard\nD3,,hard\n ,C4,easy\n", encoding="utf-8")
    truth = read_answer_key(spark, f"file://{tmp_path}/key.csv", ["dms", "crm"])
    assert truth.count() == 2
    found = spark.createDataFrame([("D1", "C1"), ("D2", "C9")], "dms string, crm string")
    by = {r.match_difficulty: (r.found, r.missed) for r in matching.evaluate_by(truth, found, ["dms", "crm"], "match_difficulty").collect()}
    assert by == {"easy": (1, 0), "hard": (0, 1)}
    names = spark.createDataFrame([("D2", "Ada")], "dms string, dms_name string"), spark.createDataFrame([("C2", "Adda")], "crm string, crm_name string")
    assert [(r.dms_name, r.crm_name) for r in matching.misses(truth, found, ["dms", "crm"], *names).collect()] == [("Ada", "Adda")]
