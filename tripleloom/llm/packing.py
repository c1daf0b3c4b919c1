"""Packing: concatenate and cut.

Pass one encodes the documents where they lie and notes, for each partition,
how many ids it holds and where each document starts in it.  The prefix sum of
the partitions' totals (one number each) turns these into places in the
concatenation of everything.  Pass two cuts at multiples of the window: windows
that lie inside a partition are finished there; a window that reaches over a
partition's edge leaves boundary records, which are joined by window number.
Nothing but boundary records is shuffled, and no row depends on how many
documents another source or key has.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, tokens

WINDOW, END = 4096, 2
_TOKENS = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
_PIECE = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("offset", pa.int64())])
_WINDOWS = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64()), ("whole", pa.bool_()), ("ids", pa.binary()), ("pieces", pa.list_(_PIECE))])
_TOKENS_SQL = "part int, doc_id long, at long, n long, ids binary"
_PIECES_SQL = "array<struct<doc_id:long,start:long,length:long,ids_crc32:long,doc_tokens:long,offset:long>>"
_WINDOWS_SQL = f"sequence_id long, offset long, whole boolean, ids binary, pieces {_PIECES_SQL}"


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = tokens.encoder(path), TaskContext.get().partitionId(), 0
        last = np.array([end], "<u4").tobytes()
        for b in shared.slices(batches, "text", 4 << 20):
            ids = [x + last for x in enc.encode(b.column(1).to_pylist())]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            # stored as 16-bit numbers where they fit, which halves the table
            yield shared.table({"part": np.full(len(ids), part, np.int32), "doc_id": b.column(0), "at": starts, "n": n, "ids": [_narrow(x) for x in ids]}, _TOKENS)

    return shared.tidy(run, encoder=False)


def _narrow(ids: bytes) -> bytes:
    x = np.frombuffer(ids, "<u4")
    return b"\x02" + x.astype("<u2").tobytes() if not len(x) or x.max() < 65536 else b"\x04" + ids


def _wide(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if ids[0] == 2 else "<u4", offset=1).astype("<u4")


def _cut(base: np.ndarray, window: int):
    """Windows and boundary records from rows in the order in which they were written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held: list[np.ndarray] = []
        pieces: list[dict] = []
        begin = place = 0  # of what is held, and of the next id, in the whole

        def flush() -> None:
            nonlocal held, pieces
            if held:
                ids = np.concatenate(held)
                rows.append((begin // window, begin % window, len(ids) == window, ids.tobytes(), pieces))
                held, pieces = [], []

        def out() -> pa.RecordBatch:
            b = shared.table(dict(zip(_WINDOWS.names, map(list, zip(*rows, strict=True)), strict=True)), _WINDOWS)
            rows.clear()
            return b

        for b in shared.slices(batches, "ids", 4 << 20):
            for part, doc, at, n, raw in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                start = int(base[part]) + at
                if start != place:  # another file, or another part of one
                    flush()
                    begin = place = start
                ids, done = _wide(raw), 0
                while done < n:
                    take = min(n - done, window - place % window)
                    cut = ids[done : done + take]
                    held.append(cut)
                    pieces.append({"doc_id": doc, "start": done, "length": take, "ids_crc32": crc32(cut.tobytes()), "doc_tokens": n, "offset": place % window})
                    done, place = done + take, place + take
                    if place % window == 0:
                        flush()
                        begin = place
                if len(rows) >= 256:
                    yield out()
        flush()
        if rows:
            yield out()

    return shared.tidy(run)


def pack(docs: DataFrame, *, vocabulary: str | None = None, end: int = END, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack documents into sequences of ``window`` ids.

    Returns one row per sequence: ``sequence_id``; ``ids`` (binary, little-endian
    unsigned 32-bit); ``n_ids``; ``padded`` (its length after padding: ``window``,
    or ``n_ids`` itself where that is a power of two); ``pieces``, an array of
    (doc_id, start, length, ids_crc32, doc_tokens, offset) without gaps from
    offset 0.  Only the last sequence can be shorter than the window.

    Null and empty texts give one id, ``end``.  A null id stays null.  Repeated
    rows are packed as often as they occur.  An empty table gives no sequence.
    Columns other than the two named are not looked at.  A text of any length is
    encoded whole; its ids are held once by the task that reads it.
    """
    spark = docs.sparkSession
    shared.ship(spark)
    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows, at = shared.write(x.mapInArrow(_encode(vocabulary or tokens.vocabulary(), end), _TOKENS_SQL), "pack-ids")
    totals = rows.groupBy("part").agg(F.sum("n").alias("n")).toArrow()  # a row for each partition of the input
    base = np.zeros((max(totals.column(0).to_pylist(), default=-1)) + 2, np.int64)
    base[totals.column(0).to_numpy() + 1] = totals.column(1).to_numpy()
    base = np.cumsum(base)
    cut, _ = shared.write(rows.mapInArrow(_cut(base, window), _WINDOWS_SQL), "pack-windows")
    shared.remove(spark, at)
    whole = cut.filter("whole").select("sequence_id", "ids", "pieces")
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "pieces")))  # at most `window` records
    edge = (
        cut.filter("not whole").groupBy("sequence_id").agg(parts.alias("p"))
        .select(
            "sequence_id",
            F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"),
            F.expr("flatten(transform(p, x -> x.pieces))").alias("pieces"),
        )
    )
    n = F.expr("cast(octet_length(ids) / 4 as long)")
    return whole.unionByName(edge).select("sequence_id", "ids", n.alias("n_ids"), F.when(F.bit_count(n) == 1, n).otherwise(F.lit(window).cast("long")).alias("padded"), "pieces")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents, one row each."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("sequence_id", F.expr("inline(pieces)"))
