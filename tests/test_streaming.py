"""Verbs on streams."""

from millrace import aggregate, const, count, get, group_by, sift, sum
from millrace.streaming import read_stream, tumbling, watermark, write_stream


def test_stream_equals_batch(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 3 AS k", "timestamp_seconds(id * 60) AS ts").write.parquet(f"{tmp_path}/in")
    stream = read_stream(f"{tmp_path}/in", "id long, k long, ts timestamp")
    query = stream >> sift(lambda r: r.id >= 10) >> group_by(k=get("k")) >> aggregate(s=sum(get("id")))
    run = query >> write_stream(name="sums", mode="complete", checkpoint=f"{tmp_path}/c1")
    run.processAllAvailable()
    run.stop()
    got = {r.k: r.s for r in spark.table("sums").collect()}
    assert got == {k: __import__("builtins").sum(i for i in range(10, 100) if i % 3 == k) for k in range(3)}


def test_time_windows(spark, tmp_path):
    spark.range(120).selectExpr("id", "timestamp_seconds(id * 60) AS ts").write.parquet(f"{tmp_path}/in")
    stream = read_stream(f"{tmp_path}/in", "id long, ts timestamp") >> watermark("ts", "10 minutes")
    query = stream >> group_by(w=tumbling("ts", "30 minutes")) >> aggregate(n=count(const(1)))
    run = query >> write_stream(name="windows", mode="complete", checkpoint=f"{tmp_path}/c2")
    run.processAllAvailable()
    run.stop()
    assert sorted(r.n for r in spark.table("windows").collect()) == [30, 30, 30, 30]
