"""Fitting tables to margins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import checkpointed

#: Entries up to which a table is fitted in one task (40 MB).
SMALL = 1_000_000


def ipf(support: DataFrame, rows: DataFrame, cols: DataFrame, sweeps: int = 20, small: int = SMALL) -> DataFrame:
    """``(row, col, x)``: the table on ``support(row, col, w)`` scaled to ``rows(row, rt)`` and ``cols(col, ct)``.

    Alternate rescaling, ending with the rows.  A table of up to ``small`` entries is
    one task's.  Beyond that a half-sweep is one aggregate and one join, after
    which the lineage is cut: the plan would double otherwise.
    """
    x = checkpointed(support.join(rows, "row").join(cols, "col").select("row", "col", F.col("w").cast("double").alias("x"), F.col("rt").cast("double").alias("rt"), F.col("ct").cast("double").alias("ct")))
    if x.count() <= small:
        kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in x.schema.fields[:2])
        return x.coalesce(1).mapInPandas(_fit(sweeps), f"{kind}, x double")
    for _ in range(sweeps):
        for key, target in (("col", "ct"), ("row", "rt")):
            s = x.groupBy(key).agg(F.sum("x").alias("s"))
            x = checkpointed(x.join(s, key).withColumn("x", F.when(F.col("s") > 0, F.col("x") * F.col(target) / F.col("s")).otherwise(0.0)).drop("s"))
    return x.select("row", "col", "x")


def _fit(sweeps: int):
    def run(batches):
        import numpy as np
        import pandas as pd

        parts = [b for b in batches if len(b)]
        if not parts:
            return
        t = pd.concat(parts).sort_values(["row", "col"], ignore_index=True)  # sums in one order
        x = t["x"].to_numpy().copy()
        sides = [(np.unique(t[key], return_inverse=True)[1], t[target].to_numpy()) for key, target in (("col", "ct"), ("row", "rt"))]
        for _ in range(sweeps):
            for at, target in sides:
                s = np.bincount(at, x)[at]
                x = np.divide(x * target, s, out=np.zeros(len(x)), where=s > 0)
        yield t[["row", "col"]].assign(x=x)

    return run
