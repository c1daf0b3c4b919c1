"""Token output as sorted-string-table shards.

File format (all numbers little-endian unless said otherwise)::

    block*            entries in key order
    index             one entry per block: last key, place, length
    bloom filter      bits
    footer            fixed size, ends with the magic number

A key is 13 bytes that sort as the rows do: a null flag, the document id
(big-endian, sign bit flipped) and a running number among equal ids.  A block
holds entries until it has ``BLOCK`` bytes, then the places of its restart
points, their number and a checksum.  An entry is (bytes shared with the key
before, rest of the key, length of the value, the value); every ``RESTART``
entries a key is written in full.  The value is the document's ids as unsigned
16-bit numbers where all fit, else 32-bit; its first byte says which.
"""

from __future__ import annotations

import io
import struct
from bisect import bisect_left
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, tokens
from .packing import _narrow, _wide

END, BLOCK, RESTART, SHARD, BLOOM_BITS, BLOOM_HASHES = 1, 32 << 10, 16, 64 << 20, 10, 7
MAGIC = b"TLSST\x00\x00\x01"
_FOOTER = struct.Struct("<QQQQQQ8s")


def key_of(doc_id: int | None, nth: int = 0) -> bytes:
    return (b"\0" + b"\0" * 8 if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))) + struct.pack(">I", nth)


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def _bloom_places(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key[:9])
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Writes one shard; keys must come in ascending order."""

    def __init__(self, sink):
        self.sink, self.at, self.index, self.keys = sink, 0, [], []
        self.block, self.restarts, self.entries, self.last, self.total = bytearray(), [], 0, b"", 0

    def add(self, key: bytes, ids: bytes) -> None:
        if self.keys and key <= self.keys[-1]:
            raise ValueError("keys must ascend")
        value, same = _narrow(ids), 0
        if self.entries % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            while same < len(key) and key[same] == self.last[same]:
                same += 1
        self.block += struct.pack("<BBI", same, len(key) - same, len(value)) + key[same:] + value
        self.last, self.entries, self.total = key, self.entries + 1, self.total + len(ids) // 4
        self.keys.append(key)
        if len(self.block) >= BLOCK:
            self._end_block()

    def _end_block(self) -> None:
        if self.entries:
            raw = bytes(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
            raw += struct.pack("<I", crc32(raw))
            self.sink.write(raw)
            self.index.append((self.last, self.at, len(raw)))
            self.at += len(raw)
            self.block, self.restarts, self.entries, self.last = bytearray(), [], 0, b""

    def close(self) -> None:
        self._end_block()
        index = b"".join(k + struct.pack("<QI", a, n) for k, a, n in self.index)
        bits = max(64, len(self.keys) * BLOOM_BITS + 7 & ~7)
        bloom = np.zeros(bits, bool)
        for k in self.keys:
            bloom[_bloom_places(k, bits)] = True
        raw = np.packbits(bloom, bitorder="little").tobytes()
        self.sink.write(index + raw + _FOOTER.pack(self.at, len(index), len(raw), len(self.keys), self.total, crc32(index + raw), MAGIC))


class Reader:
    """Reads one shard from a seekable file."""

    def __init__(self, source):
        self.source = source
        end = source.seek(0, io.SEEK_END)
        source.seek(end - _FOOTER.size)
        at, n_index, n_bloom, self.docs, self.total, check, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        source.seek(at)
        raw = source.read(n_index + n_bloom)
        if crc32(raw) != check:
            raise ValueError("index or filter is damaged")
        step = 13 + 12
        self.index = [(raw[i : i + 13], *struct.unpack("<QI", raw[i + 13 : i + step])) for i in range(0, n_index, step)]
        self.last_keys = [k for k, _, _ in self.index]
        self.bloom = raw[n_index:]

    def _block(self, i: int) -> bytes:
        _, at, n = self.index[i]
        self.source.seek(at)
        raw = self.source.read(n)
        if crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("block is damaged")
        return raw[:-4]

    @staticmethod
    def _entries(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            same, rest, n = struct.unpack_from("<BBI", raw, at)
            at += 6
            key = key[:same] + raw[at : at + rest]
            yield key, raw[at + rest : at + rest + n]
            at += rest + n

    @staticmethod
    def _parts(raw: bytes) -> tuple[tuple[int, ...], int]:
        (n,) = struct.unpack("<I", raw[-4:])
        end = len(raw) - 4 - 4 * n
        return struct.unpack(f"<{n}I", raw[end:-4]), end

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.index)):
            raw = self._block(i)
            for key, value in self._entries(raw, 0, self._parts(raw)[1]):
                yield key, _wide(value)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of the rows with this id, by filter, block index and binary search."""
        first = key_of(doc_id)
        if any(not self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(first, len(self.bloom) * 8)):
            return []
        found: list[np.ndarray] = []
        for i in range(bisect_left(self.last_keys, first), len(self.index)):
            raw = self._block(i)
            restarts, end = self._parts(raw)
            lo, hi = 0, len(restarts) - 1
            while lo < hi:  # the last restart point whose key is not above the one sought
                mid = (lo + hi + 1) // 2
                if raw[restarts[mid] + 6 : restarts[mid] + 19] <= first:
                    lo = mid
                else:
                    hi = mid - 1
            for key, value in self._entries(raw, restarts[lo], end):
                if key[:9] > first[:9]:
                    return found
                if key[:9] == first[:9]:
                    found.append(_wide(value))
        return found


def _open(path: str, write: bool = False):
    """A file of the shared folder, on any file system that pyarrow knows by its address."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(shared.address(path))
    return (store, at, store.open_output_stream(at)) if write else store.open_input_file(at)


_MADE = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])
_MADE_SQL = "part int, shard int, path string, docs long, tokens long, bytes long"


def _write(vocabulary: str, end: int, folder: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, last = tokens.encoder(vocabulary), np.array([end], "<u4").tobytes()
        task = TaskContext.get()
        part, shard, out, before, nth, made = task.partitionId(), 0, None, (), 0, []

        def close():
            nonlocal out, shard
            if out:
                w, store, temp, path = out
                w.close()
                w.sink.close()
                size = store.get_file_info(temp).size
                store.move(temp, path[1])  # a file under its final name is whole; a second attempt writes the same bytes
                made.append((part, shard, path[0], len(w.keys), w.total, size))
                out, shard = None, shard + 1

        for b in shared.slices(batches, "text", 4 << 20):
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                nth = nth + 1 if before == (doc,) else 0
                before = (doc,)
                if out is None:
                    path = f"{folder}/{part:06d}-{shard:05d}.sst"
                    store, at, sink = _open(f"{path}.{task.taskAttemptId()}.tmp", write=True)
                    out = Writer(sink), store, at, (path, at.rpartition(".sst")[0] + ".sst")
                out[0].add(key_of(doc, nth), ids + last)
                if out[0].at >= most:
                    close()
        close()
        if made:
            yield shared.table(dict(zip(_MADE.names, map(list, zip(*made, strict=True)), strict=True)), _MADE)

    return run


def write_shards(docs: DataFrame, *, vocabulary: str | None = None, end: int = END, folder: str | None = None, shard_bytes: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode documents and write them as shards in ascending id order.

    Returns the manifest: part, shard (together the order of the files), path,
    docs, tokens, bytes, and ``start``, the ids in all files before it.  Null ids
    come first; rows with equal ids follow each other by their texts, and ranges
    are dealt by (id, hash of the text), so a frequent id does not fill one task.
    Null and empty texts hold the end id alone.  An empty table gives no file.
    """
    spark = docs.sparkSession
    shared.ship(spark)
    folder = folder or shared.scratch(spark, "sst")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    x = x.withColumn("h", F.xxhash64("text"))
    x = x.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    made, _ = shared.write(x.mapInArrow(_write(vocabulary or tokens.vocabulary(), end, folder, shard_bytes), _MADE_SQL), "sst-manifest")
    # A row for each shard of 64 MB: this is a list of files, not of documents.
    rows = made.orderBy("part", "shard").toArrow()
    starts = np.cumsum([0, *rows.column("tokens").to_pylist()])[:-1]
    return spark.createDataFrame(rows.append_column("start", pa.array(starts, pa.int64()))) if rows.num_rows else spark.createDataFrame([], f"{_MADE_SQL}, start long")


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _read(digest: bool):
    schema = pa.schema([*list(_READ)[:3], ("ids_crc32", pa.int64())]) if digest else _READ

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with _open(path) as f:
                    rows: list[tuple] = []
                    held = 0
                    for key, ids in Reader(f).scan():
                        raw = ids.tobytes()
                        rows.append((id_of(key), start, len(ids), crc32(raw) if digest else raw))
                        start, held = start + len(ids), held + (0 if digest else len(raw))
                        if len(rows) >= 5000 or held > 8 << 20:
                            yield shared.table(dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)), schema)
                            rows, held = [], 0
                    if rows:
                        yield shared.table(dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)), schema)

    return run


def read_shards(manifest: DataFrame, digest: bool = False) -> DataFrame:
    """Documents read back from the files: doc_id, start, n_tokens and ids, or their checksum."""
    files = manifest.select("path", "start").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism), "path")
    return files.mapInArrow(_read(digest), "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary"))


def lookup(manifest: DataFrame, doc_ids: list[int]) -> dict[int, list[np.ndarray]]:
    """Ids of a few documents, read through filter and index."""
    found: dict[int, list[np.ndarray]] = {d: [] for d in doc_ids}
    for row in manifest.orderBy("part", "shard").collect():
        with _open(row.path) as f:
            r = Reader(f)
            for d in doc_ids:
                found[d] += r.get(d)
    return found


def op4_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids as they stand in the written files."""
    return read_shards(write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet")), digest=True)
