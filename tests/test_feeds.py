"""Feeds: reads, batches written again, streams that load a file once; operators that no named query covers."""

from pyspark.sql import functions as F

from lakeforge.operators import matching, quality, scd2
from lakeforge.sources.files import Feed, new_watermark, read_feed, with_audit
from lakeforge.sources.sinks import read_table, replace_batch
from lakeforge.streaming.feeds import ingest_available, read_stream, windowed_counts


def test_csv_and_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes("id;ad\n1;Şule\n2;Işık\n".encode("windows-1254"))
    feed = Feed("people", "crm", str(tmp_path / "in"), delimiter=";", encoding="windows-1254")
    df = with_audit(read_feed(spark, feed), feed, "b1")
    assert {r["ad"] for r in df.collect()} == {"Şule", "Işık"}
    out = str(tmp_path / "out")
    assert replace_batch(df, out, "b1") == {"rows_read": 2, "rows_written": 2, "rows_rejected": 0}
    assert replace_batch(df.where("id = '1'"), out, "b1")["rows_written"] == 1
    assert replace_batch(df.withColumn("more", F.lit(1)), out, "2")["rows_written"] == 2
    assert {(r._batch_id, r.more) for r in read_table(spark, out).collect()} == {("b1", None), ("2", 1)}
    assert replace_batch(df.where("false"), out, "b1")["rows_written"] == 0
    assert read_table(spark, out).count() == 2


def test_watermark_and_folders(spark, tmp_path):
    for day in ("2024-01-01", "2024-01-02"):
        (tmp_path / day).mkdir()
        (tmp_path / day / "x.jsonl").write_text(f'{{"day": "{day}"}}\n')
    feed = Feed("days", "dms", str(tmp_path), format="jsonl", dated_folders=True)
    assert [r["day"] for r in read_feed(spark, feed, "2024-01-01").collect()] == ["2024-01-02"]
    assert read_feed(spark, feed, "2024-01-02") is None
    assert new_watermark("2024-01-02", "2024-01-01") == "2024-01-02"


def test_stream_loads_a_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    feed = Feed("s", "dms", str(tmp_path / "in"))
    where = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    (tmp_path / "in" / "a.csv").write_text("id,v\n1,x\n2,\n")
    ingest_available(read_stream(spark, feed, ["id", "v"]), *where)
    (tmp_path / "in" / "b.csv").write_text("id,v\n3,z\n")
    for _ in range(2):
        ingest_available(read_stream(spark, feed, ["id", "v"]), *where)
    assert sorted(r["id"] for r in spark.read.parquet(where[0]).collect()) == ["1", "2", "3"]


def test_windows_close_by_watermark(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("at,k\n2024-01-01 00:01:00,a\n2024-01-01 00:02:00,a\n2024-01-01 05:00:00,a\n")
    stream = read_stream(spark, Feed("s", "dms", str(tmp_path / "in")), ["at", "k"]).withColumn("at", F.to_timestamp("at"))
    ingest_available(windowed_counts(stream, "at", "10 minutes", "10 minutes", ["k"]), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert [r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [2]


def test_ids_and_survivorship(spark):
    shape = "string, name string, email string, phone string, city string, modified date"
    a = spark.createDataFrame([("1", "Ali", None, "5", "x", None), ("2", "B", "b", "6", "y", None)], f"a_id {shape}")
    b = spark.createDataFrame([("9", "Alı", "m", "7", "z", None)], f"b_id {shape}")
    pairs = spark.createDataFrame([("1", "9")], "a_id string, b_id string")
    known = spark.createDataFrame([(None, "9", "MST00000007")], "a_id string, b_id string, master_id string")
    got = {r["a_id"]: r for r in matching.stable_ids(matching.golden(pairs, a, b, "a_id", "b_id"), known, "a_id", "b_id").collect()}
    assert (got["1"]["master_id"], got["1"]["name"], got["1"]["email"], got["1"]["phone"]) == ("MST00000007", "Alı", "m", "5")
    assert (got["2"]["master_id"], got["2"]["source_presence"]) == ("MST00000008", "DMS_ONLY")
    assert matching.reduction(pairs, a, b).first().asDict() == {"candidates": 1, "possible": 2, "reduction": 0.5}


def test_type1_keeps_members_without_source(spark):
    dim = spark.createDataFrame([("a", 1, "old"), ("b", 2, "old")], "k string, sk int, v string")
    got = scd2.type1(dim, spark.createDataFrame([("b", "new"), ("c", "new")], "k string, v string"), "k", "sk")
    assert {(r["k"], r["sk"], r["v"]) for r in got.collect()} == {("a", 1, "old"), ("b", 2, "new"), ("c", 3, "new")}


def test_detection_and_logs(spark):
    two = "rule_code string, business_key string"
    got = quality.detection(spark.createDataFrame([("R", "1"), ("R", "2")], two), spark.createDataFrame([("R", "1"), ("R", "3")], two)).first()
    assert (got["injected"], got["detected"], got["without_injection"], got["recall"]) == (2, 1, 1, 0.5)
    log = spark.createDataFrame([("1", "x", "SUCCEEDED", 5, 5), ("1", "y", "FAILED", 5, 0)], "batch_id string, step string, status string, rows_read int, rows_written int")
    assert quality.reconcile(log).first()["status"] == "FAILED"
