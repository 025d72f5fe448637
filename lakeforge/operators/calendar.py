"""The date dimension with holidays and half days, and its views by role."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Holidays on the same day each year (month, day, name, half day).
FIXED_HOLIDAYS = (
    (1, 1, "Yılbaşı", False),
    (4, 23, "Ulusal Egemenlik ve Çocuk Bayramı", False),
    (5, 1, "Emek ve Dayanışma Günü", False),
    (5, 19, "Atatürk'ü Anma, Gençlik ve Spor Bayramı", False),
    (7, 15, "Demokrasi ve Millî Birlik Günü", False),
    (8, 30, "Zafer Bayramı", False),
    (10, 28, "Cumhuriyet Bayramı Arifesi", True),
    (10, 29, "Cumhuriyet Bayramı", False),
)
# Religious feasts (first whole day, name, whole days). The day before is a half day.
FEASTS = (
    ("2023-04-21", "Ramazan Bayramı", 3),
    ("2023-06-28", "Kurban Bayramı", 4),
    ("2024-04-10", "Ramazan Bayramı", 3),
    ("2024-06-16", "Kurban Bayramı", 4),
    ("2025-03-30", "Ramazan Bayramı", 3),
    ("2025-06-06", "Kurban Bayramı", 4),
    ("2026-03-20", "Ramazan Bayramı", 3),
    ("2026-05-27", "Kurban Bayramı", 4),
)
# Names of days and months (first in the business's language, then English) and short names of days.
DAYS = (("Pazartesi", "Monday", "Pzt"), ("Salı", "Tuesday", "Sal"), ("Çarşamba", "Wednesday", "Çar"), ("Perşembe", "Thursday", "Per"), ("Cuma", "Friday", "Cum"), ("Cumartesi", "Saturday", "Cmt"), ("Pazar", "Sunday", "Paz"))
MONTHS = (
    ("Ocak", "January"), ("Şubat", "February"), ("Mart", "March"), ("Nisan", "April"), ("Mayıs", "May"), ("Haziran", "June"),
    ("Temmuz", "July"), ("Ağustos", "August"), ("Eylül", "September"), ("Ekim", "October"), ("Kasım", "November"), ("Aralık", "December"),
)
#: The years that the dimension covers unless told otherwise.
FIRST, LAST = "2022-01-01", "2027-12-31"
#: What a role's view shows, by its name there.
ROLE_COLUMNS = {"date_key": "date_key", "date": "full_date", "month": "month_year_label", "quarter": "quarter_label", "year": "year_number"}


def holidays(spark: SparkSession, first: str = FIRST, last: str = LAST) -> DataFrame:
    """One row a holiday between two days: holiday_date, holiday_name, is_half_day (0 or 1).

    Where several fall on a day, a whole day beats a half one, and then the smallest name does.
    """
    start, end = (F.lit(x).cast("date") for x in (first, last))
    rules = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(d).alias("d"), F.lit(n).alias("name"), F.lit(h).alias("half")) for m, d, n, h in FIXED_HOLIDAYS))
    years = spark.range(1).select(F.explode(F.sequence(F.year(start), F.year(end))).alias("y"), rules.alias("rules"))
    fixed = years.select("y", F.inline("rules")).select(F.make_date("y", "m", "d").alias("day"), "name", "half")
    feasts = spark.createDataFrame(list(FEASTS), "first string, name string, days int").select("name", F.expr("posexplode(sequence(date_sub(date(first), 1), date_add(date(first), days - 1)))").alias("at", "day"))
    feasts = feasts.select("day", F.when(F.col("at") == 0, F.concat("name", F.lit(" Arifesi"))).otherwise(F.col("name")).alias("name"), (F.col("at") == 0).alias("half"))
    all_days = fixed.unionByName(feasts).where(F.col("day").between(start, end))
    best = F.min(F.struct("half", "name"))
    return all_days.groupBy(F.col("day").alias("holiday_date")).agg(best.alias("b")).select("holiday_date", F.col("b.name").alias("holiday_name"), F.col("b.half").cast("int").alias("is_half_day"))


def dim_date(spark: SparkSession, first: str = FIRST, last: str = LAST, marks: DataFrame | None = None) -> DataFrame:
    """One row a day and the member -1; `marks` are the holidays, those above unless given.

    Half days are working days. Keys of the year before are null where that year is not covered. The fiscal year is the calendar's.
    """
    start, d = F.lit(first).cast("date"), F.col("full_date")
    marks = holidays(spark, first, last) if marks is None else marks
    days = spark.range(1).select(F.explode(F.sequence(start, F.lit(last).cast("date"))).alias("full_date"))
    days = days.join(F.broadcast(marks.withColumnRenamed("holiday_date", "full_date")), "full_date", "left")  # at most a row a day
    named = lambda rows, i, at: F.element_at(F.array(*(F.lit(r[i]) for r in rows)), at)
    dow, month, quarter, year = (F.weekday(d) + 1).alias("day_of_week"), F.month(d), F.quarter(d), F.year(d)
    whole, half = F.coalesce(F.col("is_half_day") == 0, F.lit(False)), F.coalesce(F.col("is_half_day") == 1, F.lit(False))
    before = F.add_months(d, -12)
    out = days.select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"), "full_date", F.dayofmonth(d).alias("day_of_month"), F.dayofyear(d).alias("day_of_year"), dow,
        named(DAYS, 0, dow).alias("day_name"), named(DAYS, 1, dow).alias("day_name_en"), named(DAYS, 2, dow).alias("day_short"), F.weekofyear(d).alias("iso_week"),
        F.extract(F.lit("YEAROFWEEK"), d).cast("int").alias("iso_year"), F.date_sub(d, F.weekday(d)).alias("week_start_date"), month.alias("month_number"), named(MONTHS, 0, month).alias("month_name"),
        named(MONTHS, 1, month).alias("month_name_en"), (year * 100 + month).alias("month_key"), F.date_format(d, "yyyy-MM").alias("month_year_label"), F.trunc(d, "month").alias("first_day_of_month"),
        F.last_day(d).alias("last_day_of_month"), F.dayofmonth(F.last_day(d)).alias("days_in_month"), quarter.alias("quarter_number"), F.concat(year, F.lit("-Q"), quarter).alias("quarter_label"),
        year.alias("year_number"), year.alias("fiscal_year"), quarter.alias("fiscal_quarter"), month.alias("fiscal_month"), (dow >= 6).cast("int").alias("is_weekend"), whole.cast("int").alias("is_public_holiday"),
        half.cast("int").alias("is_half_day"), "holiday_name", ((dow < 6) & ~whole).cast("int").alias("is_working_day"),
        F.when(before >= start, F.date_format(before, "yyyyMMdd").cast("int")).alias("same_date_last_year_key"), F.when(before >= start, (year - 1) * 100 + month).alias("same_month_last_year_key"),
    )
    texts = {"day_name": "Bilinmiyor", "day_name_en": "Unknown", "day_short": "Blm", "month_name": "Bilinmiyor", "month_name_en": "Unknown", "month_year_label": "Unknown", "quarter_label": "Unknown"}
    fixed = texts | dict.fromkeys(("full_date", "week_start_date", "first_day_of_month", "last_day_of_month"), "1900-01-01") | dict.fromkeys(("holiday_name", "same_date_last_year_key", "same_month_last_year_key")) | {"date_key": -1}
    unknown = spark.range(1).select(*(F.lit(fixed.get(f.name, 0)).cast(f.dataType).alias(f.name) for f in out.schema))
    return out.unionByName(unknown)


def as_role(dates: DataFrame, role: str) -> DataFrame:
    """The dimension under a role's name: <role>_date_key, <role>_date, <role>_month, <role>_quarter and <role>_year."""
    return dates.select(*(F.col(c).alias(f"{role}_{name}") for name, c in ROLE_COLUMNS.items()))


def current(dim: DataFrame) -> DataFrame:
    """A dimension's versions that hold now, without the columns that only versions need; special members stay."""
    return dim.where("is_current").drop("valid_from", "valid_to", "is_current", "_row_hash")
