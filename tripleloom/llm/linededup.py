"""Line deduplication with a sharded minimal perfect hash.

1. Each line that is long enough is hashed (128 bits).  A batch of texts gives one
   row per hash and partition: the documents that hold it and the largest id
   among them.  So a line that is everywhere is a row per batch from here on.
2. Rows are summed by hash, and the distinct hashes go to shards.  A shard's minimal
   perfect hash maps its n hashes one to one onto 0..n-1, where three arrays hold
   a 64-bit fingerprint, the count and the last holder.
3. The documents' hashes probe the arrays: each shard is opened once, by the task that gets the
   hashes of that shard, and what reaches the threshold goes back to the
   partition that asked.  There the lines are dropped; texts are never shuffled or joined.

A hash outside the index also maps to some place, where its fingerprint differs:
with 64 bits that the place does not depend on, 10^12 probes of foreign lines
give a false match with a probability below 10^-7.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

MIN_CHARS, MIN_DOCS, PER_SHARD, GAMMA = 40, 5, 1 << 20, 2.0
_MAGIC = b"TLMPH\x00\x00\x01"


class PerfectHash:
    """Minimal perfect hash of 64-bit numbers: levels of bit arrays, ranked by population counts."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # uint64 words
        self.ranks, before = [], 0
        for words in levels:
            n = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(before + np.cumsum(n) - n)
            before += int(n.sum())
        self.size = before

    @staticmethod
    def _place(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = keys ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (1 << 64) - 1)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
        return (x % np.uint64(bits)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys`` must be distinct."""
        levels: list[np.ndarray] = []
        while len(keys):
            bits = max(64, int(len(keys) * GAMMA) + 63 & ~63)
            at = cls._place(keys, len(levels), bits)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            keys = keys[~alone[at]]
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; -1 where it is certain that it was not among those built from."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = self._place(keys[open_], level, len(words) * 64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (words[word] >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = ranks[word[hit]] + below[hit]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out


class Shard:
    """A perfect hash with its arrays."""

    def __init__(self, mph: PerfectHash, prints: np.ndarray, counts: np.ndarray, owners: np.ndarray):
        self.mph, self.prints, self.counts, self.owners = mph, prints, counts, owners

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> Shard:
        # two hashes may share their upper half: the key mixes both halves
        mph = PerfectHash.build(_key(hi, lo))
        at = mph.index(_key(hi, lo))
        s = cls(mph, np.empty(len(hi), np.uint64), np.empty(len(hi), np.uint32), np.empty(len(hi), np.int64))
        s.prints[at], s.counts[at], s.owners[at] = lo, np.minimum(counts, 2**32 - 1), owners
        return s

    def probe(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (0: not there) and last holder of each hash."""
        at = self.mph.index(_key(hi, lo))
        if not len(self.prints):
            return np.zeros(len(hi), np.int64), np.zeros(len(hi), np.int64)
        ok = (at >= 0) & (self.prints[at] == lo)
        return np.where(ok, self.counts[at].astype(np.int64), 0), np.where(ok, self.owners[at], 0)

    def to_bytes(self) -> bytes:
        head = struct.pack(f"<8sII{len(self.mph.levels)}Q", _MAGIC, len(self.prints), len(self.mph.levels), *map(len, self.mph.levels))
        raw = head + b"".join(x.tobytes() for x in (*self.mph.levels, self.prints, self.owners, self.counts))
        return raw + struct.pack("<I", crc32(raw))

    @classmethod
    def from_bytes(cls, raw: bytes) -> Shard:
        magic, n, k = struct.unpack_from("<8sII", raw)
        if magic != _MAGIC or crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("not a whole shard")
        sizes, at, levels = struct.unpack_from(f"<{k}Q", raw, 16), 16 + 8 * k, []
        for x in sizes:
            levels.append(np.frombuffer(raw, "<u8", x, at))
            at += 8 * x
        return cls(PerfectHash(levels), np.frombuffer(raw, "<u8", n, at), np.frombuffer(raw, "<u4", n, at + 16 * n), np.frombuffer(raw, "<i8", n, at + 8 * n))


def _key(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return hi ^ (lo << np.uint64(32) | lo >> np.uint64(32))


def lines_of(text: bytes | None, min_chars: int) -> tuple[list[bytes], list[int], list[bytes]]:
    """A text's lines; the numbers of those whose key is long enough; these keys' hashes."""
    lines = (text or b"").split(b"\n")
    which, hashes = [], []
    for i, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line.strip(shared.WHITE).lower()
            if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
                which.append(i)
                hashes.append(xxhash.xxh3_128_digest(key))
    return lines, which, hashes


_HASHES = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("owner", pa.int64())])
_HASHES_SQL = "hi long, lo long, part long, n long, owner long"
_NONE = -(2**63)


def _hash(min_chars: int):
    """Rows (rid, id, text) to a row per hash and partition of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.slices(batches, "text", 32 << 20):
            found, sizes = [], []
            for text in shared.texts(b, "text"):
                h = dict.fromkeys(lines_of(text, min_chars)[2])
                found += h
                sizes.append(len(h))
            if not found:
                continue
            x = np.frombuffer(b"".join(found), ">u8").reshape(-1, 2).astype(np.uint64).view(np.int64)
            part, doc = (np.repeat(c, sizes) for c in (b.column(0).to_numpy() >> 33, b.column(1).fill_null(_NONE).to_numpy()))
            order = np.lexsort((x[:, 1], x[:, 0], part))
            hi, lo, part, doc = x[order, 0], x[order, 1], part[order], doc[order]
            at = np.flatnonzero(np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]) | (part[1:] != part[:-1])])
            yield shared.table({"hi": hi[at], "lo": lo[at], "part": part[at], "n": np.diff(np.r_[at, len(hi)]), "owner": np.maximum.reduceat(doc, at)}, _HASHES)

    return shared.tidy(run)


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Hashes of the long lines of ``docs(rid, doc_id, text)``, a row per hash, batch and partition, written down."""
    shared.ship(docs.sparkSession)
    return shared.write(docs.mapInArrow(_hash(min_chars), _HASHES_SQL), "line-hashes")[0]


def _build(folder: str):
    """Write one shard's file; a second attempt writes the same bytes under the same name."""
    from .sstable import _open

    def run(group: pa.Table) -> pa.Table:
        k = group.column("shard")[0].as_py()
        num = lambda c, t: group.column(c).to_numpy().astype(np.int64).view(t)
        raw = Shard.build(num("hi", np.uint64), num("lo", np.uint64), num("n", np.int64), group.column("owner").to_numpy()).to_bytes()
        path = _file(folder, k)
        store, at, sink = _open(f"{path}.{TaskContext.get().taskAttemptId()}.tmp", write=True)
        with sink:
            sink.write(raw)
        store.move(at, at.rpartition(".mph")[0] + ".mph")
        return pa.table({"shard": pa.array([k], pa.int32()), "path": [path], "keys": pa.array([group.num_rows], pa.int64()), "bytes": pa.array([len(raw)], pa.int64())})

    return run


def _file(folder: str, shard: int) -> str:
    return f"{folder}/{shard:06d}.mph"


def index_lines(hashes: DataFrame, *, folder: str | None = None, per_shard: int = PER_SHARD) -> tuple[int, str]:
    """Build the index of all distinct hashes of :func:`line_hashes`; the number of shards, and the folder of their files."""
    spark = hashes.sparkSession
    shared.ship(spark)
    folder = folder or shared.scratch(spark, "mph")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    distinct, at = shared.write(hashes.groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.max("owner").alias("owner")), "line-counts")
    n = distinct.count()
    # few lines are still dealt out over the tasks there are, 65,536 to a shard at least
    shards = max(-(-n // per_shard), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n >> 16))
    if shards:
        made = distinct.withColumn("shard", F.expr(f"cast(pmod(lo, {shards}) as int)")).groupBy("shard").applyInArrow(_build(folder), "shard int, path string, keys long, bytes long")
        made.agg(F.sum("keys")).collect()
    shared.remove(spark, at)
    return shards, folder


_HITS = pa.schema([("rid", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("owner", pa.int64())])


def _probe(folder: str, min_docs: int):
    """Rows (shard, hi, lo, part), sorted by shard, to those whose count in the shard's arrays reaches the threshold."""
    from .sstable import _open

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = -1, None
        for b in batches:
            shard, hi, lo, part = (b.column(i).to_numpy() for i in range(4))
            at = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(shard) else np.empty(0, np.int64)
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if shard[i] != number:
                    number = int(shard[i])
                    with _open(_file(folder, number)) as f:
                        held = Shard.from_bytes(f.read())
                count, owner = held.probe(hi[i:j].view(np.uint64), lo[i:j].view(np.uint64))
                hit = i + np.flatnonzero(count >= min_docs)
                if len(hit):
                    yield shared.table({"rid": part[hit] << 33, "hi": hi[hit], "lo": lo[hit], "owner": owner[hit - i]}, _HITS)

    return shared.tidy(run)


def frequent(hashes: DataFrame, index: tuple[int, str], min_docs: int) -> DataFrame:
    """``(rid, hi, lo, owner)``: the hashes of each partition (the first row number of which ``rid`` is) that ``min_docs`` documents or more hold."""
    shards, folder = index
    asks = hashes.select(F.expr(f"cast(pmod(lo, {max(1, shards)}) as int) as shard"), "hi", "lo", "part")
    return asks.repartition("shard").sortWithinPartitions("shard").mapInArrow(_probe(folder, min_docs), "rid long, hi long, lo long, owner long")


def _drop(at: tuple[str, int], min_chars: int, names: list[str], text_col: str, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = -1, {}
        for b in shared.slices(batches, text_col):
            col = lambda c: b.column(b.schema.get_field_index(c))  # noqa: E731, B023
            ids = col(id_col).cast(pa.int64()).fill_null(_NONE).to_pylist()
            out, n_lines, n_gone = [], [], []
            for rid, me, text in zip(col("_rid").to_pylist(), ids, shared.texts(b, text_col), strict=True):
                if rid >> 33 != part:
                    part, t = rid >> 33, shared.read_part(at, rid >> 33)
                    keys = np.empty((0, 2), ">u8") if t is None else np.stack([t.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo")], 1).astype(">u8")
                    raw = keys.tobytes()
                    held = {raw[16 * i : 16 * i + 16]: own for i, own in enumerate([] if t is None else t.column("owner").to_pylist())}
                lines, which, hashes = lines_of(text, min_chars) if held else ((text or b"").split(b"\n"), (), ())
                bad = {w for w, h in zip(which, hashes, strict=True) if held.get(h, me) != me}
                n_lines.append(len(lines))
                n_gone.append(len(bad))
                out.append(b"\n".join(line for i, line in enumerate(lines) if i not in bad) if bad else text)
            new = {"_n_lines": pa.array(n_lines, pa.int64()), "_n_dropped": pa.array(n_gone, pa.int64()), text_col: pa.array(out, pa.binary()).cast(pa.string())}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else col(c) for c in names], names=names)

    return shared.tidy(run)


def drop_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, per_shard: int = PER_SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop lines that many documents hold, except from the last holder.

    A text splits at line feeds; a line's key is the line without white space at
    both ends and with A-Z lowered.  Lines whose key has ``min_chars`` code points
    or more and is found in ``min_docs`` rows or more are dropped, except in the
    rows with the largest id among the key's holders.

    Returns the rows with all columns, the text replaced, and the columns
    ``_n_lines`` (before) and ``_n_dropped`` (input columns of these names, and of
    the name ``_rid``, go).  A null text counts as one empty line and stays null;
    null ids are below all others; of rows with equal ids each counts as a
    document and all are the last holder together.  Very long texts are read
    whole.  An empty table gives an empty table.
    """
    from pyspark.sql.types import LongType, StructField, StructType

    docs = docs.drop("_n_lines", "_n_dropped", "_rid").withColumn(text_col, F.col(text_col).cast("string"))
    rows, _ = shared.write(docs.withColumn("_rid", F.monotonically_increasing_id()), "line-docs")
    hashes = line_hashes(rows.select(F.col("_rid").alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), min_chars)
    index = index_lines(hashes, per_shard=per_shard)
    at = shared.write_by_part(frequent(hashes, index, min_docs), "line-frequent", rows.select(F.col("_rid").alias("rid")))
    out = StructType([*docs.schema.fields, StructField("_n_lines", LongType()), StructField("_n_dropped", LongType())])
    return rows.mapInArrow(_drop(at, min_chars, out.names, text_col, id_col), out)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents' lines, and a digest of what is left."""
    x = drop_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return x.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), kept.alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (
  SELECT doc_id, i, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
often AS (
  SELECT k, max(doc_id) AS owner FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT keyed.*, owner IS NOT NULL AND owner <> doc_id AS gone FROM keyed LEFT JOIN often USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
