"""All pairs of blocks, each once, dealt out by chunks."""

from collections import Counter

from pyspark.sql import functions as F

from lakeforge.operators import matching
from lakeforge.plans.queries import queries


def _sides(spark, n):
    people = [(i, f"NAME{i % 3} X", str(i // 2) if i % 5 else "", "C" if i % 4 else "D", str(i % 7) * 10) for i in range(n)]
    df = spark.createDataFrame(people, "id int, full_name string, identity_no string, city string, phone string").withColumn("email", F.lit(None).cast("string"))
    return matching.standardise(df, "id", "a", "s"), matching.standardise(df.where("id % 2 = 1 or id > 12"), "id", "b", "s")


def test_pairs_are_those_of_the_blocks_each_once(spark):
    left, right = _sides(spark, 60)
    want = Counter((r.a_id, r.b_id) for r in matching.blocked(left, right, "a", "b").collect())
    for chunk in (1, 3, 1000):
        assert Counter((r.a_id, r.b_id) for r in matching.block_pairs(left, right, "a", "b", chunk=chunk).collect()) == want


def test_the_query_gives_pairs(spark):
    got = queries()["identity_and_name_blocks"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["a_id", "b_id"] and got.count() == got.distinct().count() == 1181
