"""Provinces by code, and the region that a code lies in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Code, province, region and inhabitants in millions.
PROVINCES = (
    ("01", "Adana", "Akdeniz", "2.27"),
    ("02", "Adıyaman", "Güneydoğu Anadolu", "0.64"),
    ("03", "Afyonkarahisar", "Ege", "0.75"),
    ("04", "Ağrı", "Doğu Anadolu", "0.51"),
    ("05", "Amasya", "Karadeniz", "0.34"),
    ("06", "Ankara", "İç Anadolu", "5.8"),
    ("07", "Antalya", "Akdeniz", "2.69"),
    ("08", "Artvin", "Karadeniz", "0.17"),
    ("09", "Aydın", "Ege", "1.15"),
    ("10", "Balıkesir", "Marmara", "1.26"),
    ("11", "Bilecik", "Marmara", "0.23"),
    ("12", "Bingöl", "Doğu Anadolu", "0.28"),
    ("13", "Bitlis", "Doğu Anadolu", "0.35"),
    ("14", "Bolu", "Karadeniz", "0.32"),
    ("15", "Burdur", "Akdeniz", "0.27"),
    ("16", "Bursa", "Marmara", "3.24"),
    ("17", "Çanakkale", "Marmara", "0.56"),
    ("18", "Çankırı", "İç Anadolu", "0.2"),
    ("19", "Çorum", "Karadeniz", "0.53"),
    ("20", "Denizli", "Ege", "1.06"),
    ("21", "Diyarbakır", "Güneydoğu Anadolu", "1.8"),
    ("22", "Edirne", "Marmara", "0.41"),
    ("23", "Elazığ", "Doğu Anadolu", "0.6"),
    ("24", "Erzincan", "Doğu Anadolu", "0.24"),
    ("25", "Erzurum", "Doğu Anadolu", "0.75"),
    ("26", "Eskişehir", "İç Anadolu", "0.92"),
    ("27", "Gaziantep", "Güneydoğu Anadolu", "2.16"),
    ("28", "Giresun", "Karadeniz", "0.45"),
    ("29", "Gümüşhane", "Karadeniz", "0.15"),
    ("30", "Hakkari", "Doğu Anadolu", "0.28"),
    ("31", "Hatay", "Akdeniz", "1.69"),
    ("32", "Isparta", "Akdeniz", "0.45"),
    ("33", "Mersin", "Akdeniz", "1.94"),
    ("34", "İstanbul", "Marmara", "15.65"),
    ("35", "İzmir", "Ege", "4.46"),
    ("36", "Kars", "Doğu Anadolu", "0.28"),
    ("37", "Kastamonu", "Karadeniz", "0.39"),
    ("38", "Kayseri", "İç Anadolu", "1.45"),
    ("39", "Kırklareli", "Marmara", "0.37"),
    ("40", "Kırşehir", "İç Anadolu", "0.24"),
    ("41", "Kocaeli", "Marmara", "2.08"),
    ("42", "Konya", "İç Anadolu", "2.31"),
    ("43", "Kütahya", "Ege", "0.58"),
    ("44", "Malatya", "Doğu Anadolu", "0.81"),
    ("45", "Manisa", "Ege", "1.47"),
    ("46", "Kahramanmaraş", "Akdeniz", "1.18"),
    ("47", "Mardin", "Güneydoğu Anadolu", "0.87"),
    ("48", "Muğla", "Ege", "1.05"),
    ("49", "Muş", "Doğu Anadolu", "0.4"),
    ("50", "Nevşehir", "İç Anadolu", "0.31"),
    ("51", "Niğde", "İç Anadolu", "0.37"),
    ("52", "Ordu", "Karadeniz", "0.76"),
    ("53", "Rize", "Karadeniz", "0.35"),
    ("54", "Sakarya", "Marmara", "1.09"),
    ("55", "Samsun", "Karadeniz", "1.37"),
    ("56", "Siirt", "Güneydoğu Anadolu", "0.33"),
    ("57", "Sinop", "Karadeniz", "0.22"),
    ("58", "Sivas", "İç Anadolu", "0.64"),
    ("59", "Tekirdağ", "Marmara", "1.14"),
    ("60", "Tokat", "Karadeniz", "0.6"),
    ("61", "Trabzon", "Karadeniz", "0.82"),
    ("62", "Tunceli", "Doğu Anadolu", "0.09"),
    ("63", "Şanlıurfa", "Güneydoğu Anadolu", "2.21"),
    ("64", "Uşak", "Ege", "0.38"),
    ("65", "Van", "Doğu Anadolu", "1.13"),
    ("66", "Yozgat", "İç Anadolu", "0.42"),
    ("67", "Zonguldak", "Karadeniz", "0.58"),
    ("68", "Aksaray", "İç Anadolu", "0.44"),
    ("69", "Bayburt", "Karadeniz", "0.08"),
    ("70", "Karaman", "İç Anadolu", "0.26"),
    ("71", "Kırıkkale", "İç Anadolu", "0.28"),
    ("72", "Batman", "Güneydoğu Anadolu", "0.63"),
    ("73", "Şırnak", "Güneydoğu Anadolu", "0.57"),
    ("74", "Bartın", "Karadeniz", "0.2"),
    ("75", "Ardahan", "Doğu Anadolu", "0.08"),
    ("76", "Iğdır", "Doğu Anadolu", "0.2"),
    ("77", "Yalova", "Marmara", "0.3"),
    ("78", "Karabük", "Karadeniz", "0.25"),
    ("79", "Kilis", "Güneydoğu Anadolu", "0.15"),
    ("80", "Osmaniye", "Akdeniz", "0.56"),
    ("81", "Düzce", "Karadeniz", "0.4"),
)
UNKNOWN = ("-1", "Bilinmiyor", "Bilinmiyor", None)


def provinces(spark: SparkSession) -> DataFrame:
    """province_code, province_name, region, population_m, and the member -1."""
    rows = spark.createDataFrame([*PROVINCES, UNKNOWN], "province_code string, province_name string, region string, population_m string")
    return rows.withColumn("population_m", F.col("population_m").cast("decimal(9,2)"))


def with_region(df: DataFrame, code: str, unknown: bool = False) -> DataFrame:
    """The rows with the `region` of their province. A code of one digit is not its two-digit form.

    Codes that are null or of no province have none, or with `unknown` that of the member -1.
    """
    known = provinces(df.sparkSession).select(F.col("province_code").alias("_code"), "region")
    out = df.join(F.broadcast(known), F.col(code) == F.col("_code"), "left").drop("_code")  # 82 rows
    return out.withColumn("region", F.coalesce("region", F.lit(UNKNOWN[2]))) if unknown else out
