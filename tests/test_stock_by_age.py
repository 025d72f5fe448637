"""Stock by day and age without a row a vehicle and day."""

import datetime as dt

from pyspark.sql import functions as F

from lakeforge.operators import facts


def test_stock_by_age_is_not_expanded_by_vehicle(spark):
    day = dt.date.fromisoformat
    vehicles = spark.createDataFrame([("v1", day("1995-01-01"), "D1", "M1", 5), ("v2", day("1995-01-01"), "D1", "M2", None), ("v3", day("1995-03-01"), None, "M1", 7), ("v4", None, "D1", "M1", 1), ("v5", day("1995-05-01"), "D1", "M1", 2)], "vin string, arrival_date date, stock_dealer_code string, model_trim_code string, dealer_cost_try int")
    vehicles = vehicles.withColumn("dealer_cost_try", F.col("dealer_cost_try").cast("decimal(18,2)"))
    contracts = spark.createDataFrame([("v1", "NEW", day("1995-02-10")), ("v1", "NEW", day("1995-02-20")), ("v5", "NEW", day("1995-05-01"))], "vin string, sale_type string, delivery_date date")
    version = lambda key, rows: spark.createDataFrame([(k, day(a), day(b), sk) for k, a, b, sk in rows], f"{key} string, valid_from date, valid_to date, sk long")
    star = {
        "vehicle": version("vin", [("v1", "1995-01-05", "1995-01-20", 1), ("v1", "1995-01-20", "9999-12-31", 2)]).withColumnRenamed("sk", "vehicle_sk"),
        "dealer": version("dealer_code", [("D1", "1990-01-01", "1995-01-10", 3), ("D1", "1995-01-10", "9999-12-31", 4)]).withColumnRenamed("sk", "dealer_sk"),
        "model": version("model_trim_code", [("M1", "1990-01-01", "9999-12-31", 5)]).withColumnRenamed("sk", "model_sk"),
    }
    sums = {"stock_value": "stock_value_amount", "vehicle_sks": "vehicle_sk", "dealer_sks": "dealer_sk", "model_sks": "model_sk"}
    daily = facts.inventory_daily(vehicles, contracts, star, "1995-06-01").groupBy("snapshot_date_key", "age_band").agg(F.count("*").alias("vehicles"), F.max("days_in_stock").alias("oldest"), *(F.sum(c).alias(n) for n, c in sums.items()))
    by_age = facts.inventory_by_age(vehicles, contracts, star, "1995-06-01", sums)
    assert by_age.schema.simpleString() == daily.schema.simpleString()
    assert sorted(map(str, by_age.collect())) == sorted(map(str, daily.collect()))
