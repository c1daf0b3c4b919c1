"""Studies: what a graph made for a signature measures, over seeds and settings."""

from __future__ import annotations

import logging
import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features
from . import analytics, signature

log = logging.getLogger(__name__)
_RUN = "config string, seed int, block string, feature string, target double, achieved double, relative_error double"


def round_trip(spark: SparkSession, values: dict[str, float], seeds: list[int], blocks: list[str], config: str = "", measure: dict | None = None, **generator) -> DataFrame:
    """``(config, seed, block, feature, target, achieved, relative_error)``: a graph made for ``values`` with each seed, measured again.

    The runs follow one another, each distributed; a run's rows are as many as it has features.
    """
    from ..generator.rewire import generate

    rows = []
    for seed in seeds:
        got = signature.measure(generate(spark, values, seed, **generator), blocks, **(measure or {}))
        for b in blocks:
            for f in features.BLOCKS[b.lower()]:
                t, x = values.get(f, math.nan), got[f]
                if not math.isnan(t) and not math.isnan(x):
                    rows.append((config, seed, b.lower(), f, float(t), float(x), abs(t - x) / max(abs(t), 1e-9)))
        log.info("%s seed %d: %d features measured", config or "round trip", seed, len(rows))
    return spark.createDataFrame(rows, _RUN)


def sweep(spark: SparkSession, values: dict[str, float], settings: dict[str, dict], seeds: list[int], blocks: list[str], measure: dict | None = None) -> DataFrame:
    """``(config, feature, mean, std, n)`` of the relative errors of :func:`round_trip` under each named setting of the generator."""
    runs = [round_trip(spark, values, seeds, blocks, name, measure, **more) for name, more in settings.items()]
    return analytics.sweep_summary(reduce(DataFrame.union, runs), ["config", "feature"], "relative_error")


def delta_profile(swaps: DataFrame) -> DataFrame:
    """``(bucket, n, mean_abs, share, accept_rate)`` of a log of swaps by the power of two of its largest end's degree; ``share`` is the bucket's share of all change."""
    x = swaps.withColumn("bucket", F.floor(F.log2(F.greatest(F.col("degree"), F.lit(1)))).cast("int")).withColumn("m", F.abs("delta"))
    all_ = x.agg(F.sum("m").alias("all"))
    by = x.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("m").alias("mean_abs"), F.sum("m").alias("m"), F.avg(F.col("accepted").cast("double")).alias("accept_rate"))
    return by.join(F.broadcast(all_), F.lit(True)).select("bucket", "n", "mean_abs", F.when(F.col("all") > 0, F.col("m") / F.col("all")).alias("share"), "accept_rate")


def guard_effect(swaps: DataFrame, guard: int) -> DataFrame:
    """``(n, passed_over, change_lost)``: swaps with an end above a degree guard, as a share of all, and their share of all change."""
    m, over = F.abs("delta"), F.col("degree") > guard
    return swaps.agg(F.count(F.lit(1)).alias("n"), F.avg(over.cast("double")).alias("passed_over"), (F.sum(F.when(over, m).otherwise(0.0)) / F.sum(m)).alias("change_lost"))
