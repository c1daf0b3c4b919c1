"""Tables of runs: CSV with a header and JSON lines, in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = {"csv": {"header": True}, "jsonl": {}}


def _kind(path: str, kind: str | None) -> str:
    kind = kind or path.rstrip("/").rpartition(".")[2].lower()
    if kind not in FORMATS:
        raise ValueError(f"{path}: neither of {sorted(FORMATS)}")
    return kind


def read_table(spark: SparkSession, path: str, kind: str | None = None, schema: str | None = None) -> DataFrame:
    """A table by its ending (or ``kind``); without a schema types are inferred."""
    kind = _kind(path, kind)
    reader = spark.read.options(**FORMATS[kind])
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True) if kind == "csv" else reader
    return reader.csv(path) if kind == "csv" else reader.json(path)


def write_table(df: DataFrame, path: str, kind: str | None = None, mode: str = "errorifexists") -> None:
    """A folder of files in the format of the path's ending (or ``kind``)."""
    kind = _kind(path, kind)
    writer = df.write.mode(mode).options(**FORMATS[kind])
    writer.csv(path) if kind == "csv" else writer.json(path)
