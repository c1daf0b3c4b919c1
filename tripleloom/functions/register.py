"""The fits as SQL functions, for sessions that want them in SQL text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .fits import MIN_SAMPLES, power_alpha


def register(spark: SparkSession) -> list[str]:
    """Register ``powerlaw_alpha`` (aggregate of positive counts, support from 1), ``powerlaw_alpha_of`` (of sufficient
    statistics, vectorised) and ``parse_turtle`` (table function); their names."""
    from pyspark.sql.functions import pandas_udf, udtf

    from ..plans.session import ship
    from ..sources.rdf import parse_turtle

    ship(spark)

    @pandas_udf("double")
    def alpha(x: pd.Series) -> float:
        import numpy as np

        v = x.dropna()
        v = v[v > 0].to_numpy(dtype=float)
        return float("nan") if len(v) < MIN_SAMPLES else power_alpha(len(v), float(np.log(v).sum()), 1, int(v.max()))

    @pandas_udf("double")
    def alpha_of(n: pd.Series, sum_log: pd.Series, hi: pd.Series) -> pd.Series:
        return pd.Series([power_alpha(int(a), float(b), 1, int(c)) for a, b, c in zip(n, sum_log, hi, strict=True)], dtype=float)

    @udtf(returnType="s string, p string, o string, o_is_literal boolean, o_datatype string, o_lang string")
    class Turtle:
        def eval(self, text: str):
            yield from parse_turtle(text or "")

    spark.udf.register("powerlaw_alpha", alpha)
    spark.udf.register("powerlaw_alpha_of", alpha_of)
    spark.udtf.register("parse_turtle", Turtle)
    return ["powerlaw_alpha", "powerlaw_alpha_of", "parse_turtle"]


def sufficient(value: str) -> list[F.Column]:
    """Aggregates that ``powerlaw_alpha_of`` takes: count, sum of logarithms, largest value."""
    x = F.when(F.col(value) > 0, F.col(value).cast("double"))
    return [F.count(x).alias("n"), F.sum(F.log(x)).alias("sum_log"), F.max(x).cast("long").alias("hi")]
