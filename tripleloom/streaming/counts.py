"""Structured Streaming: relation usage of a stream of triples, and windows over timed events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def relation_counts(triples: DataFrame) -> DataFrame:
    """Running ``(p, n_edges)``; state is one row per relation."""
    return triples.groupBy("p").agg(F.count(F.lit(1)).alias("n_edges"))


def distinct_triples(triples: DataFrame, time: str, late: str = "1 hour") -> DataFrame:
    """Triples without repeats that come within the watermark; older state is dropped."""
    return triples.withWatermark(time, late).dropDuplicatesWithinWatermark(["s", "p", "o"])


def windowed(events: DataFrame, time: str = "ts", every: str = "1 day", late: str = "1 day") -> DataFrame:
    """``(start, event_type, n, total)`` per tumbling window, late rows beyond the watermark left out."""
    x = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return x.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, time: str = "ts", gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """``(user_id, start, end, n)`` per session of a user."""
    x = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.session_window(time, gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return x.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run_once(df: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> StreamingQuery:
    """Process all that is there into a Parquet table of the shared folder, seen as the view ``name``, and stop."""
    from ..plans.session import scratch

    spark = df.sparkSession
    path = scratch(spark)
    spark.createDataFrame([], df.schema).write.parquet(path)
    put = lambda batch, _: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)
    q = df.writeStream.outputMode(mode).foreachBatch(put).trigger(availableNow=True).option("checkpointLocation", checkpoint or scratch(spark)).start()
    q.awaitTermination()
    spark.read.schema(df.schema).parquet(path).createOrReplaceTempView(name)
    return q


def streamed_relation_counts(spark: SparkSession, folder: str, schema: str = "s string, p string, o string") -> DataFrame:
    """Relation usage of the Parquet files that have come to a folder."""
    run_once(relation_counts(spark.readStream.schema(schema).parquet(folder)), "streamed_relation_counts")
    return spark.table("streamed_relation_counts")
