"""Wall time of the headline queries at one scale: one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from lakeforge.plans.entities import build_star
from lakeforge.plans.queries import queries

#: Left out: queries that differ from a timed one in their last step only, and evaluate all 25 rules again.
VARIANTS = {"rule_violations", "rule_scorecard", "quality_measures", "fact_data_quality", "quarantine_lines"}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    began = time.perf_counter()
    build_star(spark, folder)
    times = {"star_build": round(time.perf_counter() - began, 3)}  # once a session; queries over the star read its tables
    for name, query in queries().items():
        if name in VARIANTS:
            continue
        query(spark, folder).write.format("noop").mode("overwrite").save()  # compiles
        began = time.perf_counter()
        query(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
