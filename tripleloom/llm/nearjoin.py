"""N-gram Jaccard join with Bayesian candidate pruning.

1. Each text becomes its set of word shingles, as 64-bit hashes, and 128 MinHash
   values.  Texts with the same set form a class; from here on a class counts once.
2. Classes that agree in a band of 4 values share a bucket.  At similarity 0.8 a
   pair shares none of the 32 bands with a probability of 5e-8.  A pair is looked at
   in the bucket of the first band that it shares and nowhere else.
3. There, the MinHash values (8 bits of each) are compared 32 at a time.  After
   each step the number of matches gives the posterior of the similarity (uniform
   prior: a Beta distribution); a pair goes when the posterior probability of
   reaching the threshold falls below ``TOLERANCE``.
4. The members of the pairs that stay, not the pairs, get their shingle sets sent to that
   bucket.  The pairs take the same test with whole values, and what is
   left is verified by exact intersections and counted for both ends.

A bucket with more members than ``CHUNK`` is dealt out as a grid of blocks of chunk
pairs, so no task gets an unbounded group, nothing is capped and rows stay linear
in the documents.  Pairs that meet in no bucket are never compared, however
long the chain of others between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from . import shared

WORDS, THRESHOLD, VALUES, ROWS, TOLERANCE = 5, 0.8, 128, 4, 1e-7
STEP, CHUNK = 32, 512
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _spread(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_SEEDS = _spread(np.arange(1, 2 * VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, VALUES)
_words: dict[bytes, int] = {}


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's lower-cased word n-grams; one of all words where there are fewer."""
    parts = (text or "").lower().encode().split()
    if not parts:
        return np.empty(0, np.uint64)
    if len(_words) > 500_000:
        _words.clear()
    get, hashes = _words.get, []
    for w in parts:
        if (h := get(w)) is None:
            h = _words[w] = xxhash.xxh3_64_intdigest(w)
        hashes.append(h)
    h = np.array(hashes, np.uint64)
    n = min(words, len(h))
    with np.errstate(over="ignore"):
        x = np.full(len(h) - n + 1, n, np.uint64)
        for j in range(n):
            x = _spread(x + h[j : len(h) - n + 1 + j])
    return np.unique(x)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, 32 bits each, a row for each set; an empty set has the largest values."""
    out = np.full((len(sets), VALUES), 2**32 - 1, np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        x = np.concatenate([sets[i] for i in full])
        starts = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
        buf = np.empty_like(x)
        with np.errstate(over="ignore"):
            for k in range(VALUES):
                np.bitwise_xor(x, _SEEDS[0, k], out=buf)
                np.multiply(buf, _SEEDS[1, k] | np.uint64(1), out=buf)
                out[full, k] = (np.minimum.reduceat(buf, starts) >> np.uint64(32)).astype(np.uint32)
    return out


def needed(threshold: float, tolerance: float, bits: int = 32) -> list[int]:
    """Matches that a pair must have after each step, or its posterior of reaching the threshold is below the tolerance.

    With a uniform prior, P(J >= t | m of n match) = P(Binomial(n + 1, t) <= m).
    With few bits, t becomes the probability that two values of such a pair agree.
    """
    from .quality import binomial_tail

    t = threshold + (1 - threshold) / 2**bits
    return [next(m for m in range(n + 1) if binomial_tail(m, n + 1, t) >= tolerance) for n in range(STEP, VALUES + 1, STEP)]


def survivors(a: np.ndarray, b: np.ndarray, need: list[int]) -> np.ndarray:
    """Which rows of ``a`` and ``b`` (signatures, pair by pair) stay, compared step by step."""
    left, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for i, least in enumerate(need):
        s = slice(i * STEP, (i + 1) * STEP)
        matches = matches + (a[left, s] == b[left, s]).sum(1, dtype=np.int32)
        ok = matches >= least
        left, matches = left[ok], matches[ok]
    return left


def whole_groups(batches: Iterator[pa.RecordBatch], col: str) -> Iterator[pa.RecordBatch]:
    """Batches of sorted rows, cut so that no value of ``col`` lies in two."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(col)).to_numpy()
        if held and held[-1].column(b.schema.get_field_index(col))[0].as_py() != k[0]:
            yield pa.concat_batches(held)
            held = []
        last = int(np.searchsorted(k == k[-1], True)) if k[0] != k[-1] else 0
        if last:
            yield pa.concat_batches([*held, b.slice(0, last)])
            held = []
        held.append(b.slice(last))
    if held:
        yield pa.concat_batches(held)


def _bounds(k: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, k[1:] != k[:-1], True])


_SIGNED = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("sig", pa.binary())])


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.slices(batches, "text", 1 << 20):
            sets = [shingles(t, words) for t in b.column(2).to_pylist()]
            h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
            sig = signatures(sets)
            yield shared.table({"rid": b.column(0), "doc_id": b.column(1), "h1": h[:, 0], "h2": h[:, 1], "sig": [r.tobytes() for r in sig]}, _SIGNED)

    return shared.tidy(run)


BANDS = VALUES // ROWS


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A hash of each band of signatures (rows of 32-bit values); the number of the band is part of it."""
    sig = sig.astype(np.uint64)
    x = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS))
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            x = _spread(x * np.uint64(0x9E3779B97F4A7C15) + sig[:, j::ROWS])
    return x


def _signatures_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), -1)


@shared.tidy
def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.int64()), ("band", pa.int32()), ("cid", pa.int64())])
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            part = b.slice(at, 4096)
            x = band_keys(_signatures_of(part.column(1)))
            yield shared.table({"key": x.reshape(-1).view(np.int64), "band": np.tile(np.arange(BANDS, dtype=np.int32), len(x)), "cid": np.repeat(part.column(0).to_numpy(), BANDS)}, schema)


@shared.tidy
def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a bucket needs of a class: 32 bits of each band's hash, and 8 bits of each value."""
    schema = pa.schema([("cid", pa.int64()), ("bits", pa.binary())])
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            sig = _signatures_of(b.slice(at, 4096).column(1))
            bits = np.concatenate([band_keys(sig).astype(np.uint32).view(np.uint8), sig.astype(np.uint8)], 1)
            yield shared.table({"cid": b.slice(at, 4096).column(0), "bits": [r.tobytes() for r in bits]}, schema)


def first_met(keys: np.ndarray, side: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of a block of a band that share no earlier band; where rows have two sides, only pairs across."""
    n = len(keys)
    met = np.zeros((n, n), bool)
    for k in range(band):
        met |= keys[:, k, None] == keys[None, :, k]
    if (side != side[0]).any():
        met |= side[:, None] == side[None, :]
    return np.nonzero(np.triu(~met, 1))


_NODES = pa.schema([("block", pa.int64()), ("band", pa.int32()), ("chunk", pa.int64()), ("cid", pa.int64())])


def _candidates(need: list[int]):
    """The members of each block's pairs that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches, "block"):
            block, band, side, ids = (b.column(i).to_numpy() for i in range(4))
            bits = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint8).reshape(len(ids), -1)
            keys, sig = np.ascontiguousarray(bits[:, : 4 * BANDS]).view(np.uint32), bits[:, 4 * BANDS :]
            at = _bounds(block)
            size = np.diff(at)
            two = at[:-1][size == 2]
            two = two[(keys[two] == keys[two + 1]).argmax(1) == band[two]]  # all of them share their own band
            hit = two[survivors(sig[two], sig[two + 1], need)]
            stay = np.zeros(len(ids), bool)
            stay[hit] = stay[hit + 1] = True
            for lo, n in zip(at[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
                i, j = first_met(keys[lo : lo + n], side[lo : lo + n], int(band[lo]))
                for s in range(0, len(i), 1 << 16):
                    p, q = lo + i[s : s + (1 << 16)], lo + j[s : s + (1 << 16)]
                    ok = survivors(sig[p], sig[q], need)
                    stay[p[ok]] = stay[q[ok]] = True
            if stay.any():
                yield b.select([0, 1, 2, 3]).filter(pa.array(stay)).cast(_NODES)

    return shared.tidy(run)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 blocks over the values that two sets have at least."""
    x, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col, n = np.unique(x, return_inverse=True, return_counts=True)
    often = n > 1
    number = np.cumsum(often) - 1
    use = often[col]
    row, col = row[use], number[col[use]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for lo in range(0, int(often.sum()), 4096):
        s = slice(*np.searchsorted(col, [lo, lo + 4096]))
        m = np.zeros((len(sets), 4096), np.float32)
        m[row[s], col[s] - lo] = 1
        out += m @ m.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out.astype(np.int64)


def linked(sets: list[np.ndarray], sig: np.ndarray, keys: np.ndarray, side: np.ndarray, band: int, threshold: float, need: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of a block that meet first in its band and reach the threshold."""
    i, j = first_met(keys, side, band)
    stay = [at + survivors(sig[i[at : at + (1 << 16)]], sig[j[at : at + (1 << 16)]], need) for at in range(0, len(i), 1 << 16)]
    stay = np.concatenate(stay) if stay else np.empty(0, np.int64)
    i, j = i[stay], j[stay]
    if not len(i):
        return i, j
    if len(i) <= 8:
        common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)])
    else:
        common = intersections(sets)[i, j]
    n = np.array([len(s) for s in sets])
    ok = (common > 0) & (common >= threshold * (n[i] + n[j] - common) - 1e-9)
    return i[ok], j[ok]


_COUNTED = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _verify(threshold: float, tolerance: float):
    need = needed(threshold, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches, "block"):
            names = b.schema.names
            block, band, cid, side, copies = (b.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("block", "band", "cid", "chunk", "copies"))
            sets = [np.frombuffer(x, np.uint64) for x in b.column(names.index("set")).to_pylist()]
            at = _bounds(block)
            # signatures of many blocks at once, a few million shingles at a time
            ends, first = np.cumsum([len(s) for s in sets]), 0
            while first < len(at) - 1:
                done = ends[at[first]] - len(sets[at[first]])
                last = max(first + 1, int(np.searchsorted(ends[at[first + 1 :] - 1], done + (4 << 20), side="right")) + first)
                base = at[first]
                sig = signatures(sets[base : at[last]])
                keys = band_keys(sig).astype(np.uint32)
                for lo, hi in zip(at[first:last].tolist(), at[first + 1 : last + 1].tolist(), strict=True):
                    s = slice(lo - base, hi - base)
                    i, j = linked(sets[lo:hi], sig[s], keys[s], side[lo:hi], int(band[lo]), threshold, need)
                    if not len(i):
                        continue
                    ids, n = cid[lo:hi], copies[lo:hi]
                    links = np.bincount(i, n[j], len(ids)) + np.bincount(j, n[i], len(ids))
                    root = np.arange(len(ids))
                    while True:  # smallest row that can be reached
                        m = np.minimum(root[i], root[j])
                        if (root[i] == m).all() and (root[j] == m).all():
                            break
                        np.minimum.at(root, i, m)
                        np.minimum.at(root, j, m)
                        root = root[root]
                    yield shared.table({"cid": ids, "links": links.astype(np.int64), "root": ids[root]}, _COUNTED)
                first = last

    return shared.tidy(run)


def _sets(words: int):
    schema = pa.schema([("cid", pa.int64()), ("set", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.slices(batches, "text", 1 << 20):
            yield shared.table({"cid": b.column(0), "set": [shingles(t, words).tobytes() for t in b.column(1).to_pylist()]}, schema)

    return shared.tidy(run)


def _dealt(rows: DataFrame, key: str, members: str, chunk: int) -> DataFrame:
    """A row for each block that a row takes part in: chunk pairs of a group with ``members`` rows."""
    chunks = F.ceil(F.col(members) / chunk).cast("long")
    x = rows.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    return x.withColumn("block", F.xxhash64(key, F.least("chunk", "other"), F.greatest("chunk", "other")))


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with a number of their own, written once, so that every later read sees the same numbers."""
    return shared.write(docs.withColumn("_rid", F.monotonically_increasing_id()), "near-docs")[0]


def near_duplicates(docs: DataFrame, *, words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text", row_col: str = "_rid") -> DataFrame:
    """Classes, links and groups of similar texts; ``docs`` comes from :func:`keyed`.

    Returns a row for each row: ``rid``; ``doc_id``; ``class_id``, the smallest id
    among texts with the same shingle set; ``copies``, their number; ``n_links``,
    the other rows at the threshold or above; ``component_id``, the smallest id
    that links reach; ``kept``, true for one row of each component, the first by
    id and then by row number.

    Texts are lower-cased and split at ASCII white space.  A text of fewer than
    ``words`` words has one shingle of all of them; texts without words (null,
    empty) are one class without links to others.  Null ids are below all
    others.  Repeated rows are copies.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    shared.ship(spark)
    x = docs.select(F.col(row_col).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed, _ = shared.write(x.mapInArrow(_sign(words), "rid long, doc_id long, h1 long, h2 long, sig binary"), "near-signed")

    # classes: combined before the shuffle, so thousands of copies arrive as a row per task
    first = F.min(F.struct("doc_id", "rid")).alias("f")
    classes, _ = shared.write(
        signed.groupBy("h1", "h2").agg(first, F.count(F.lit(1)).alias("copies"), F.max("sig").alias("sig"))
        .select("h1", "h2", F.col("f.rid").alias("cid"), F.col("f.doc_id").alias("class_id"), "copies", "sig"), "near-classes",
    )

    bands, bands_at = shared.write(classes.select("cid", "sig").mapInArrow(_bands, "key long, band int, cid long"), "near-bands")
    full = bands.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    met = _dealt(bands.join(full, "key"), "key", "members", CHUNK).select("block", "band", "chunk", "cid")
    met = met.join(classes.select("cid", "sig").mapInArrow(_short, "cid long, bits binary"), "cid").select("block", "band", "chunk", "cid", "bits")
    nodes = met.repartition("block").sortWithinPartitions("block").mapInArrow(_candidates(needed(threshold, tolerance, 8)), "block long, band int, chunk long, cid long")
    nodes, nodes_at = shared.write(nodes, "near-nodes")
    shared.remove(spark, bands_at)

    few = nodes.select("cid").distinct().join(classes.select("cid", "copies"), "cid")
    few, few_at = shared.write(few, "near-members")
    # a checked size: 24 bytes a row; beyond it the texts are shuffled
    hint = F.broadcast(few.select("cid")) if few.count() <= 1_000_000 else few.select("cid")
    sets = x.join(hint, x.rid == hint.cid).select("cid", "text").mapInArrow(_sets(words), "cid long, set binary")
    blocks = nodes.join(few, "cid").join(sets, "cid").select("block", "band", "chunk", "cid", "copies", "set")
    counted = blocks.repartition("block").sortWithinPartitions("block", "cid").mapInArrow(_verify(threshold, tolerance), "cid long, links long, root long")
    counted, _ = shared.write(counted, "near-counted")
    shared.remove(spark, nodes_at, few_at)

    links = counted.groupBy("cid").agg(F.sum("links").alias("links"))
    over = counted.filter("cid <> root").select(F.col("cid").alias("u"), F.col("root").alias("v"))
    roots = connected_components(over, lambda df: shared.write(df, "near-cc")[0]).select(F.col("id").alias("cid"), F.col("component").alias("root"))
    own = (
        classes.select("h1", "h2", "cid", "class_id", "copies").join(links, "cid", "left").join(roots, "cid", "left")
        .withColumn("root", F.coalesce("root", "cid")).withColumn("links", F.coalesce("links", F.lit(0)))
    )
    heads = own.groupBy("root").agg(F.min(F.struct("class_id", "cid")).alias("head"))
    own = shared.to_rows(own, heads, ["root"], F.pmod(F.xxhash64("cid"), F.lit(64)))
    own = own.select("h1", "h2", "class_id", "copies", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("head.class_id").alias("component_id"), F.col("head.cid").alias("keep"))
    rows = shared.to_rows(signed.select("rid", "doc_id", "h1", "h2"), own, ["h1", "h2"])
    return rows.select("rid", "doc_id", "class_id", "copies", "n_links", "component_id", (F.col("rid") == F.col("keep")).alias("kept"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, number of links and group of every document."""
    docs = keyed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return near_duplicates(docs).drop("rid")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
places AS (
  SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM places),
n AS (SELECT w.doc_id, count(s) AS n FROM w LEFT JOIN g USING (doc_id) GROUP BY w.doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y, k = p.n AND k = q.n AS same FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 5 * k >= 4 * (p.n + q.n - k)
  UNION ALL SELECT p.doc_id, q.doc_id, TRUE FROM n p JOIN n q ON p.n = 0 AND q.n = 0 AND p.doc_id <> q.doc_id),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.y FROM reach r JOIN links l ON l.x = r.b),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
k AS (SELECT x, count(*) AS n_links, count(*) FILTER (same) AS twins, min(y) FILTER (same) AS twin FROM links GROUP BY x)
SELECT d.doc_id, least(d.doc_id, coalesce(twin, d.doc_id)) AS class_id, coalesce(twins, 0)::BIGINT + 1 AS copies, coalesce(n_links, 0)::BIGINT AS n_links,
       component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN k ON k.x = d.doc_id
"""
