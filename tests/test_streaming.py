from graphs import SMALL
from pyspark.sql import functions as F
from tripleloom.streaming import counts


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"s{i}", f"p{i % 3}", f"o{i % 4}") for i in range(30)]
    for k in range(3):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], "s string, p string, o string").write.parquet(str(tmp_path / f"in/{k}"))
    (tmp_path / "flat").mkdir()
    for f in (tmp_path / "in").glob("*/part-*.parquet"):
        f.rename(tmp_path / "flat" / f.name)
    got = {r.p: r.n_edges for r in counts.streamed_relation_counts(spark, str(tmp_path / "flat")).collect()}
    assert got == {"p0": 10, "p1": 10, "p2": 10}


def test_repeats_in_a_stream_come_once(spark, tmp_path):
    rows = [(f"s{i % 5}", "p", f"o{i % 3}", f"2024-01-01 00:{i:02d}:00") for i in range(40)]
    spark.createDataFrame(rows, "s string, p string, o string, t string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("s string, p string, o string, t string").parquet(str(tmp_path / "in"))
    counts.run_once(counts.distinct_triples(stream.withColumn("t", F.to_timestamp("t")), "t"), "once", "append")
    got = [(r.s, r.p, r.o) for r in spark.table("once").collect()]
    assert len(got) == len(set(got)) and set(got) == {r[:3] for r in rows}


def test_windows_and_sessions(spark):
    schema = spark.read.parquet(f"{SMALL}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SMALL)
    counts.run_once(counts.windowed(stream), "windowed", "append")
    counts.run_once(counts.sessions(stream), "sessions", "append")
    ev = spark.read.parquet(f"{SMALL}/events.parquet")
    days = {(str(r.day), r.event_type): r["count"] for r in ev.groupBy(F.to_date("ts").alias("day"), "event_type").count().collect()}
    for r in spark.table("windowed").collect():
        assert days[str(r.start.date()), r.event_type] == r.n
    assert spark.table("sessions").count() > 0
