"""Helpers that all operators of this subpackage use.

Every table that an operator needs twice is written once, as Parquet, into the
shared folder named by ``spark.checkpoint.dir``; a lost executor then costs a
re-run of its tasks and nothing else.
"""

from __future__ import annotations

import ctypes
import gc
import os
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import session

WHITE = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines see, as a whole address."""
    path = spark._jvm.org.apache.hadoop.fs.Path(session.shared_dir(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(path).toString().replace("file:///", "file:/").replace("file:/", "file:///")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which ``plans.session.clean`` deletes."""
    return session.remember(spark, f"{shared_dir(spark)}/tripleloom/{name}-{uuid.uuid4().hex[:12]}")


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables of :func:`write` once nothing reads them any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder; the table read back, and where it is."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, so that their Python can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_tripleloom_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    at = os.path.join(tempfile.mkdtemp(), "tripleloom_code.zip")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), os.path.dirname(top)))
    sc.addPyFile(at)
    sc._tripleloom_shipped = True


def table(rows: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    """A batch from columns that are lists, arrays or numpy arrays."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c := rows[f.name], pa.Array) else pa.array(c, type=f.type) for f in schema], schema=schema
    )


def release(encoder: bool = True) -> None:
    """Give a worker's free memory back to the system, and with ``encoder`` drop the tokenizer that it keeps from task to task."""
    tokens = sys.modules.get(f"{__package__}.tokens")
    if encoder and tokens:
        tokens.encoder.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator], encoder: bool = True) -> Callable[[Iterator], Iterator]:
    """``run``, followed by :func:`release`.

    Workers serve one operator after the other, and what each left allocated and
    free would add up beside the JVM's heap.
    """

    @wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release(encoder)

    return tidied


def slices(batches: Iterable[pa.RecordBatch], col: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose column ``col`` has about ``most`` bytes (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        x = b.column(b.schema.get_field_index(col))
        n = np.zeros(b.num_rows + 1, np.int64)
        sizes = pc.fill_null(pc.binary_length(x), 0)
        np.cumsum(sizes.to_numpy(zero_copy_only=False), out=n[1:])
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(n, n[at] + most, side="right")) - 1)
            yield b.slice(at, to - at)
            at = to


def texts(batch: pa.RecordBatch, col: str) -> list[bytes | None]:
    """The column's values as UTF-8 bytes."""
    x = batch.column(batch.schema.get_field_index(col))
    return x.cast(pa.large_binary() if pa.types.is_large_string(x.type) else pa.binary()).to_pylist()


def to_rows(rows: DataFrame, values: DataFrame, keys: list[str], part: Column | None = None) -> DataFrame:
    """Rows with the values of their keys; nulls where a key is null or has none.

    The values first meet a row per key and ``part`` (the partition that made
    ``rid``, if none is given), then the rows by both, so a key that a third of all
    rows have is not one task's.
    """
    part = F.shiftright("rid", 33) if part is None else part
    some = rows.select(*keys, part.alias("part")).dropna(subset=keys).distinct().join(values, keys)
    return rows.withColumn("part", part).join(some, [*keys, "part"], "left").drop("part")


#: Folders of :func:`write_by_part` at most.
FOLDERS = 4096


def write_by_part(df: DataFrame, name: str, rows: DataFrame) -> tuple[str, int]:
    """Write rows that refer to rows of the written table ``rows`` by their ``rid``, by the partition that made the ids.

    Ids from ``monotonically_increasing_id`` hold the partition above bit 33.  A
    task that reads a partition of the other table then reads the part of one
    small file, and nothing of that table is shuffled.  Beyond ``FOLDERS``
    partitions neighbours share a file, sorted, in row groups of a megabyte.
    Returns the path and the partitions to a folder.
    """
    path = scratch(df.sparkSession, name)
    width = -(-(((rows.agg(F.max("rid")).first()[0] or 0) >> 33) + 1) // FOLDERS)
    part = F.shiftright("rid", 33)
    x = df.withColumn("part", part).withColumn("folder", F.floor(part / width)).repartition("folder").sortWithinPartitions("folder", "part", "rid")
    x.write.partitionBy("folder").option("compression", "zstd").option("parquet.block.size", 1 << 20).parquet(path)
    return path, width


def address(path: str) -> str:
    """A Hadoop address as Arrow writes it."""
    scheme, colon, rest = path.partition("://")
    return {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + colon + rest


def read_part(at: tuple[str, int], part: int) -> pa.Table | None:
    """One partition's rows, by ``rid``, from what :func:`write_by_part` returned; None where there are none."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    path, width = at
    store, folder = fs.FileSystem.from_uri(f"{address(path)}/folder={part // width}")
    out = []
    for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if f.path.endswith(".parquet"):
            with store.open_input_file(f.path) as source:
                file = pq.ParquetFile(source)
                k = file.schema_arrow.get_field_index("part")
                for g in range(file.num_row_groups):
                    s = file.metadata.row_group(g).column(k).statistics
                    if s is None or not s.has_min_max or s.min <= part <= s.max:
                        rows = file.read_row_group(g)
                        out.append(rows.filter(pc.equal(rows.column("part"), part)))
    rows = pa.concat_tables(out) if out else None
    return rows.sort_by("rid").combine_chunks() if rows is not None and rows.num_rows else None
