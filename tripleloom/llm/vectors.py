"""Embedding near-deduplication with product quantisation.

A coarse quantiser puts each vector into one inverted list; its residual is
stored as one code per subspace.

Which lists to probe: let x lie nearest to centroid c and y nearest to centroid
d.  Then (x - y)(c - d) is the sum of what x is closer to c than to d and of what y
is closer to d than to c.  Both are at least 0 and the sum is at most
|x - y| |c - d|, where |x - y| <= sqrt(2 - 2 threshold).  So one of the two is at
most half of that, and a vector that probes every list within this margin meets
each of its links from one side at least: with ``deviations=None`` no link can be
missed.  The difference of a link seldom points along c - d, though: its share
there has a standard deviation of about one part in the root of the dimension
(more where the data vary more in that direction, which is measured), and by
default the margin is cut at ``DEVIATIONS`` of these.

1. A query meets the codes of the lists that it probes: queries are dealt out once,
   in blocks of neighbouring lists, and packed codes are sent to the blocks that
   want them.  Table look-ups give the similarity to each code; the length of
   what quantisation lost bounds the error, so a pair is passed over only if it
   cannot reach the threshold.
2. The members of such pairs, not the pairs, meet again by their two lists, dealt
   out as a grid, and exact cosines in double precision decide.  A pair has one
   pair of lists, so it is counted once, for both ends.

Quantisers are fitted on a bounded sample; every row is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from . import shared
from .nearjoin import _bounds, whole_groups

THRESHOLD, DEVIATIONS, SAMPLE, LISTS, PARTS, CODES, CHUNK = 0.93, 6.0, 65_536, 4096, 16, 64, 1024
#: Queries of a block, members of a packed piece of a list, and members of a list that one task packs.
QUERIES, PIECE, PACK = 2048, 512, 32_768
#: Rows up to which a table of (label, length, list) is broadcast; some 60 bytes each.
SMALL = 100_000
_SLACK = 1e-4  # more than single precision loses


class Quantiser:
    """Coarse centroids and residual codebooks for vectors of up to ``dim`` numbers (shorter ones end in zeros).

    Lists are numbered along a path from centroid to nearest centroid, so
    neighbouring numbers mean neighbouring lists.
    """

    def __init__(self, sample: np.ndarray, lists: int, threshold: float = THRESHOLD, deviations: float | None = DEVIATIONS, parts: int = PARTS, codes: int = CODES, rounds: int = 8, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.parts = min(parts, self.dim)
        self.width = -(-self.dim // self.parts)
        centroids = self._cluster(sample, lists, rounds, rng, unit=True)
        self.centroids = centroids[self._path(centroids)]
        rest = sample - self.centroids[(sample @ self.centroids.T).argmax(1)]
        left = self._split(rest)
        self.books = np.stack([self._cluster(left[:, m], codes, rounds, rng) for m in range(self.parts)])
        self.half = float(np.sqrt(max(0.0, 1 - threshold) / 2))
        self.deviations = deviations
        spread = rest.T @ rest
        self.spread = spread / max(float(np.trace(spread)), 1e-300)

    @staticmethod
    def _cluster(x: np.ndarray, k: int, rounds: int, rng, unit: bool = False) -> np.ndarray:
        c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
        for _ in range(rounds):
            near = np.concatenate([(x[i : i + 8192] @ c.T - (0 if unit else 0.5 * (c * c).sum(1))).argmax(1) for i in range(0, len(x), 8192)])
            n = np.bincount(near, minlength=len(c))
            s = np.zeros_like(c)
            np.add.at(s, near, x)
            c[n > 0] = s[n > 0] / n[n > 0, None]
            if unit:
                c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        return c

    @staticmethod
    def _path(c: np.ndarray) -> list[int]:
        out, open_ = [0], np.ones(len(c), bool)
        open_[0] = False
        while open_.any():
            out.append(int(np.where(open_, c @ c[out[-1]], -np.inf).argmax()))
            open_[out[-1]] = False
        return out

    def _split(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.parts * self.width), x.dtype)
        out[:, : self.dim] = x
        return out.reshape(len(x), self.parts, self.width)

    def margins(self, own: np.ndarray) -> np.ndarray:
        """How much less similar than list ``own`` each list may be and still be probed."""
        c, o = self.centroids, self.centroids[own]
        gap = np.sqrt(np.maximum(0, (o * o).sum(1)[:, None] + (c * c).sum(1) - 2 * o @ c.T))
        if self.deviations is None:
            return self.half * gap
        q = c @ self.spread
        by, ours = (q * c).sum(1), (q[own] * o).sum(1)
        along = np.maximum(0, ours[:, None] + by - 2 * q[own] @ c.T)  # variance of a difference along c - d, times gap squared
        along = np.sqrt(np.maximum(along, gap * gap / self.dim))
        return self.half * np.minimum(gap, self.deviations * along)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, which lists are probed, codes, and the length of what the codes lose."""
        near = x @ self.centroids.T
        best = near.argmax(1)
        probed = near >= near[np.arange(len(x)), best][:, None] - self.margins(best) - 1e-9
        left = self._split(x - self.centroids[best])
        codes = np.empty((len(x), self.parts), np.uint8)
        for m, book in enumerate(self.books):
            codes[:, m] = (left[:, m] @ book.T - 0.5 * (book * book).sum(1)).argmax(1)
            left[:, m] -= book[codes[:, m]]
        return best, probed, codes, np.sqrt((left * left).sum((1, 2)))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Similarities of each query's parts to the codes: part, query, code."""
        parts = self._split(q)
        return np.stack([parts[:, m] @ book.T.astype(q.dtype) for m, book in enumerate(self.books)])


def similarities(base: np.ndarray, tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Similarities of queries to the coded members of one list: that to its centroid and look-ups."""
    out = np.repeat(base[:, None], len(codes), 1)
    for table, code in zip(tables, codes.T, strict=True):
        out += table.take(code, axis=1)
    return out


def vectors_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as doubles, ended with zeros to the longest length, and whether each can link with anything."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    dim = int(sizes.max(initial=0))
    out = np.zeros((len(column), dim))
    flat = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become nan
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt((out * out).sum(1))
    # very long or short vectors are scaled first, so their squares don't overflow or vanish
    big = np.abs(out).max(1, initial=0)
    odd = np.isfinite(big) & (big > 0) & ~((norm > 1e-100) & (norm < 1e100))
    out[odd] /= big[odd, None]
    norm[odd] = np.sqrt((out[odd] * out[odd]).sum(1))
    ok = np.isfinite(out).all(1) & (norm > 0)
    out[~ok] = 0
    return out / np.where(ok, norm, 1)[:, None] + 0.0, ok


_VALID = pa.schema([("rid", pa.int64()), ("vec_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("label", pa.string()), ("size", pa.int32()), ("vec", pa.binary())])
_VALID_SQL = "rid long, vec_id long, h1 long, h2 long, label string, size int, vec binary"


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of length 1 and a 128-bit hash of label and vector; both null where a row links with nothing."""
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            b = whole.slice(at, 2048)
            x, ok = vectors_of(b.column(3))
            ok &= b.column(2).is_valid().to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(pc.list_value_length(b.column(3)), 0).to_pylist()
            vec = [x[i, :n].tobytes() if good else None for i, (n, good) in enumerate(zip(sizes, ok, strict=True))]
            keys = [xxhash.xxh3_128_digest(f"{label}\0{n}\0".encode() + v) if v is not None else b"\0" * 16 for label, n, v in zip(b.column(2).to_pylist(), sizes, vec, strict=True)]
            h = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            none = ~ok
            yield shared.table({"rid": b.column(0), "vec_id": b.column(1), "h1": pa.array(h[:, 0], mask=none), "h2": pa.array(h[:, 1], mask=none), "label": b.column(2), "size": np.array(sizes, np.int32), "vec": vec}, _VALID)


def _matrix(raw: list[bytes], dim: int, kind: type = np.float64) -> np.ndarray:
    out = np.zeros((len(raw), dim), kind)
    for i, x in enumerate(raw):
        v = np.frombuffer(x, kind)
        out[i, : len(v)] = v
    return out


_INDEX = pa.schema([("cid", pa.int64()), ("label", pa.string()), ("size", pa.int32()), ("list", pa.int32()), ("codes", pa.binary()), ("lost", pa.float32()), ("probes", pa.list_(pa.int32())), ("vec", pa.binary())])
_INDEX_SQL = "cid long, label string, size int, list int, codes binary, lost float, probes array<int>, vec binary"


def _index(q: Quantiser):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                x = _matrix(part.column(3).to_pylist(), q.dim)
                best, probed, codes, lost = q.encode(x)
                row, to = np.nonzero(probed)
                probes = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=len(x)))].astype(np.int32)), pa.array(to.astype(np.int32)))
                yield shared.table({"cid": part.column(0), "label": part.column(1), "size": part.column(2), "list": best.astype(np.int32), "codes": [c.tobytes() for c in codes], "lost": lost.astype(np.float32), "probes": probes, "vec": [v.tobytes() for v in x.astype(np.float32)]}, _INDEX)

    return run


def _member(parts: int) -> np.dtype:
    return np.dtype([("cid", "<i8"), ("lost", "<f4"), ("codes", "u1", (parts,))])


_PIECES = pa.schema([("label", pa.string()), ("size", pa.int32()), ("list", pa.int32()), ("piece", pa.binary())])


def _pack(parts: int):
    """Members of one list, sorted together, as pieces of up to ``PIECE``."""
    kind = _member(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches, "place"):
            at = _bounds(b.column(0).to_numpy())
            rows = np.empty(b.num_rows, kind)
            rows["cid"], rows["lost"] = b.column(4).to_numpy(), b.column(6).to_numpy()
            rows["codes"] = np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint8).reshape(-1, parts)
            cuts = [(i, min(i + PIECE, hi)) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) for i in range(lo, hi, PIECE)]
            first = pa.array([i for i, _ in cuts])
            yield shared.table({**{c: b.column(i).take(first) for i, c in enumerate(("label", "size", "list"), 1)}, "piece": [rows[i:j].tobytes() for i, j in cuts]}, _PIECES)

    return run


_NODES = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("cid", pa.int64()), ("side", pa.int32())])


def _search(q: Quantiser, threshold: float):
    """Members of pairs that can reach the threshold, by their two lists; rows are sorted by block, queries first."""
    kind = _member(q.parts)
    near_to = q.centroids.astype(np.float32)

    def nodes(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        x = np.unique(np.concatenate([np.stack(f, 1) for f in found]), axis=0)
        return shared.table({"a": x[:, 0].astype(np.int32), "b": x[:, 1].astype(np.int32), "cid": x[:, 2], "side": x[:, 3].astype(np.int32)}, _NODES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, ready, found, size = None, [], None, [], 0
        for batch in batches:
            names = batch.schema.names
            col = lambda c: batch.column(names.index(c))  # noqa: E731, B023
            blocks, member = col("block").to_pylist(), col("member").to_pylist()
            cids, lists, data = col("cid").to_pylist(), col("list").to_pylist(), col("data").to_pylist()
            for bl, is_member, c, at, raw in zip(blocks, member, cids, lists, data, strict=True):
                if bl != block:
                    block, held, ready = bl, [], None
                if not is_member:
                    held.append((c, at, raw))
                    continue
                if not held:
                    continue
                if ready is None:
                    x = _matrix([r for _, _, r in held], q.dim, np.float32)
                    own = np.array([k for _, k, _ in held])
                    near = x @ near_to.T
                    probed = near >= near[np.arange(len(x)), own][:, None] - q.margins(own).astype(np.float32) - np.float32(_SLACK)
                    ready = np.array([k for k, _, _ in held]), own, near, probed, q.tables(x)
                ids, own, near, probed, tables = ready
                use = np.flatnonzero(probed[:, at])
                if not len(use):
                    continue
                m = np.frombuffer(raw, kind)
                i, j = np.nonzero(similarities(near[use, at], tables[:, use], m["codes"]) + m["lost"] >= threshold - _SLACK)
                i = use[i]
                other = ids[i] != m["cid"][j]
                i, j = i[other], j[other]
                if not len(i):
                    continue
                for who, lists_of, facing in ((ids[i], own[i], np.full(len(i), at)), (m["cid"][j], np.full(len(i), at), own[i])):
                    low, high = np.minimum(lists_of, facing), np.maximum(lists_of, facing)
                    # a node once for each pair of lists
                    _, first = np.unique(np.stack([low, high, who], 1), axis=0, return_index=True)
                    found.append((low[first], high[first], who[first], (lists_of != low)[first].astype(np.int64)))
                    size += len(first)
                if size > 200_000:
                    yield nodes(found)
                    found, size = [], 0
        if found:
            yield nodes(found)

    return run


_FOUND = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _decide(dim: int, threshold: float):
    """Links and groups within each block by exact cosines: across its two sides, or all of one chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches, "block"):
            names = b.schema.names
            block, cid, side, copies, cross = (b.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("block", "cid", "side", "copies", "cross"))
            raw = b.column(names.index("vec")).to_pylist()
            at = _bounds(block)
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                first = side[lo:hi] == side[lo]
                if first.all():
                    if cross[lo]:
                        continue
                    x = y = _matrix(raw[lo:hi], dim)
                    p = m = np.arange(lo, hi)
                else:
                    p, m = lo + np.flatnonzero(first), lo + np.flatnonzero(~first)
                    x, y = _matrix([raw[k] for k in p], dim), _matrix([raw[k] for k in m], dim)
                hit = x @ y.T >= threshold
                if first.all():
                    hit = np.triu(hit, 1)
                i, j = np.nonzero(hit)
                if not len(i):
                    continue
                u, v = p[i] - lo, m[j] - lo
                ids, n = cid[lo:hi], copies[lo:hi]
                links = np.bincount(u, n[v], len(ids)) + np.bincount(v, n[u], len(ids))
                root = np.arange(len(ids))
                while True:
                    least = np.minimum(root[u], root[v])
                    if (root[u] == least).all() and (root[v] == least).all():
                        break
                    np.minimum.at(root, u, least)
                    np.minimum.at(root, v, least)
                    root = root[root]
                yield shared.table({"cid": ids, "links": links.astype(np.int64), "root": ids[root]}, _FOUND)

    return run


def _grid(nodes: DataFrame, chunk: int) -> DataFrame:
    """A row for each block that a node takes part in: chunk pairs across two lists, or within one."""
    key = ("label", "size", "a", "b")
    n = nodes.groupBy(*key).agg(*(F.ceil(F.sum((F.col("side") == s).cast("long")) / chunk).cast("long").alias(f"c{s}") for s in (0, 1)))
    x = shared.to_rows(nodes, n, list(key), F.pmod(F.xxhash64("cid"), F.lit(64))).withColumn("cross", F.col("a") != F.col("b"))
    own, other = F.when(F.col("side") == 0, F.col("c0")).otherwise(F.col("c1")), F.when(F.col("cross") & (F.col("side") == 0), F.col("c1")).otherwise(F.col("c0"))
    x = x.withColumn("mine", F.pmod(F.xxhash64("cid"), own)).withColumn("facing", F.explode(F.sequence(F.lit(0).cast("long"), other - 1)))
    flip = F.when(F.col("cross"), F.col("side") == 1).otherwise(F.col("mine") > F.col("facing"))
    block = F.xxhash64(*key, F.when(flip, F.col("facing")).otherwise(F.col("mine")), F.when(flip, F.col("mine")).otherwise(F.col("facing")))
    return x.select(block.alias("block"), "cid", F.when(F.col("cross"), F.col("side")).otherwise(F.col("mine")).cast("long").alias("side"), "cross", "copies", "vec")


def near_vectors(rows: DataFrame, *, threshold: float = THRESHOLD, deviations: float | None = DEVIATIONS, sample: int = SAMPLE, lists: int | None = None, chunk: int = CHUNK, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links and groups of vectors with equal labels.

    Returns a row for each row: vec_id, ``n_links`` (other rows of the same label
    at the threshold or above), ``component_id`` (smallest id that links reach) and
    ``kept`` (whether that is its own id).  Equal vectors are found as one class
    and count as often as they occur.  Vectors that are null, zero or empty or
    hold null or non-finite numbers, and rows with null label, link with nothing;
    vectors of different lengths never link.  Null ids are below all others.  Other
    columns are ignored, whatever their names.  An empty table gives an empty
    table.  There are half the root of the number of vectors in lists, 4,096 at
    most; 16 vectors for each, 16,384 at least and ``sample`` at most, are drawn by hash to fit them.
    """
    spark = rows.sparkSession
    shared.ship(spark)
    made: list[str] = []

    def put(df: DataFrame, name: str) -> DataFrame:
        df, at = shared.write(df, name)
        made.append(at)
        return df

    all_ = rows.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    all_, _ = shared.write(all_.mapInArrow(_valid, _VALID_SQL), "vec-rows")
    valid = all_.filter("h1 is not null")
    classes = valid.groupBy("h1", "h2").agg(F.min(F.struct("vec_id", "rid")).alias("f"), F.count(F.lit(1)).alias("copies"), *(F.any_value(c).alias(c) for c in ("label", "size", "vec")))
    classes, _ = shared.write(classes.select("h1", "h2", F.col("f.rid").alias("cid"), F.col("f.vec_id").alias("least"), "copies", "label", "size", "vec"), "vec-classes")
    n = classes.count()
    if not n:
        return all_.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    lists = lists or max(1, min(LISTS, int(n**0.5 / 2)))
    wanted = min(sample, max(16_384, 16 * lists))
    drawn = classes.filter(F.pmod(F.xxhash64("cid"), F.lit(1 << 30)) < int(min(1.0, 1.2 * wanted / n) * (1 << 30))).select("vec").limit(wanted).toArrow().column(0).to_pylist()
    if not drawn:
        drawn = classes.select("vec").limit(wanted).toArrow().column(0).to_pylist()
    dim = classes.agg(F.max("size")).first()[0]
    q = Quantiser(_matrix(drawn, dim), lists, threshold, deviations)

    index = put(classes.select("cid", "label", "size", "vec").mapInArrow(_index(q), _INDEX_SQL), "vec-index")
    place = ["label", "size", "list"]
    per = put(index.groupBy(*place).agg(F.count(F.lit(1)).alias("n")), "vec-lists")
    # neighbouring lists share a block until it is full; a longer list is dealt out over blocks of its own
    before = F.sum("n").over(Window.partitionBy("label", "size").orderBy("list")) - F.col("n")
    alone = F.col("n") > QUERIES
    per = per.select(*place, "n", F.when(alone, F.lit(-1) - F.col("list")).otherwise(F.floor(before / QUERIES)).cast("long").alias("unit"), F.when(alone, F.ceil(F.col("n") / QUERIES)).otherwise(1).cast("long").alias("blocks"))
    known = F.broadcast(per) if per.count() <= SMALL else per
    x = index.join(known, place)
    block = F.xxhash64("label", "size", "unit", F.pmod(F.xxhash64("cid"), F.col("blocks"))).alias("block")
    wants = x.select(block, *place[:2], F.explode("probes").alias("list")).distinct()
    dealt = x.select(F.xxhash64(*place, F.pmod(F.xxhash64("cid"), F.ceil(F.col("n") / PACK).cast("long"))).alias("place"), *place, "cid", "codes", "lost")
    pieces = dealt.repartition("place").sortWithinPartitions("place").mapInArrow(_pack(q.parts), "label string, size int, list int, piece binary")
    pieces = put(pieces, "vec-pieces")
    asks = x.select(block, F.lit(False).alias("member"), "cid", "list", F.col("vec").alias("data"))
    codes = wants.join(pieces, place).select("block", F.lit(True).alias("member"), F.lit(None).cast("long").alias("cid"), "list", F.col("piece").alias("data"))
    met = asks.unionByName(codes).repartition("block").sortWithinPartitions("block", "member").mapInArrow(_search(q, threshold), "a int, b int, cid long, side int")
    nodes = put(met.distinct(), "vec-nodes")
    nodes = nodes.join(classes.select("cid", "label", "size", "copies", "vec"), "cid")
    found = _grid(nodes, chunk).repartition("block").sortWithinPartitions("block", "cid").mapInArrow(_decide(dim, threshold), "cid long, links long, root long")
    found, _ = shared.write(found, "vec-found")

    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("cid").alias("u"), F.col("root").alias("v")).filter("u <> v"), lambda df: shared.write(df, "vec-cc")[0])
    own = classes.select("h1", "h2", "cid", "least", "copies").join(links, "cid", "left").join(roots.select(F.col("id").alias("cid"), F.col("component").alias("root")), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    heads = own.groupBy("root").agg(F.min("least").alias("component_id"))
    own = own.join(heads, "root").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("component_id").alias("c"))
    shared.remove(spark, *made)
    x = shared.to_rows(all_.select("rid", "vec_id", "h1", "h2"), own, ["h1", "h2"])
    x = x.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("h1").isNotNull(), F.col("c")).otherwise(F.col("vec_id")).alias("component_id"))
    return x.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and group of every embedding."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.v FROM reach r JOIN links l ON l.u = r.b)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN (SELECT u, count(*) AS n FROM links GROUP BY u) k ON k.u = e.vec_id
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = e.vec_id
"""
