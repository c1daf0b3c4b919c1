"""Suffix-array deduplication with deep-shallow sorting.

A byte goes if a 100-byte string that starts earlier covers it.  Suffixes that
cannot take part in such a repeat are never sorted:

1. Every window of 100 bytes has an anchor, the 32-byte string in it that comes
   first in a pseudo-random order (the leftmost of equals).  Equal windows have
   equal anchors at equal places.  Neighbouring windows share anchors; windows
   with one anchor form a segment.
2. Segments meet by anchor.  A segment that is alone has no repeat.  Of segments
   with equal contents all but the earliest go as a whole; this is settled first
   where a text lies, so a passage that is everywhere arrives once per batch.
3. Where segments of different contents meet, the suffixes that start in them are
   sorted: multikey quicksort by words of 8 bytes down to ``SHALLOW`` bytes, then
   a blind trie for each group that is still equal.  Equal neighbours in that
   order are the repeats; the earliest stays.

4. An anchor with more than ``HOT`` such segments (a common phrase that every text goes on
   from differently) is not one task's: its windows are hashed (128 bits) and the
   first of each hash is found by an aggregate, which gives the same repeats.

Hashes decide only which bytes meet and whether segments or windows are equal (128 bits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .nearjoin import _bounds, _spread, whole_groups

WINDOW, GRAM, SHALLOW, PART = 100, 32, 16, 4 << 20
#: Different segments of one anchor that a task sorts; at some 12 KB each (69 suffixes with their strings) this is 125 MB.
HOT = 10_000
_SPAN = WINDOW - GRAM + 1
_BYTES = _spread(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_FROM = np.int64(-(2**63))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def segments(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text number, first and last window, anchor hash and content hash of the segments of texts laid end to end.

    ``flat`` is a byte array of less than 2**24 bytes.
    """
    n = len(flat)
    empty = np.empty(0, np.int64)
    if n < WINDOW:
        return empty, empty, empty, empty, empty
    with np.errstate(over="ignore"):
        v = _BYTES[flat]
        h, width = v, 1
        while width < GRAM:
            h = h[:-width] * np.uint64(_BASE ^ (width << 1)) + h[width:]
            width *= 2
        gram = _spread(h)
        # ordered by the upper 40 bits; the place makes the leftmost of equals the smallest
        low = (gram & np.uint64(~0xFFFFFF & (1 << 64) - 1)) | np.arange(len(gram), dtype=np.uint64)
        width = 1
        while 2 * width <= _SPAN:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < _SPAN:
            low = np.minimum(low[: -(_SPAN - width)], low[_SPAN - width :])
        anchor = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        # windows inside one text
        text = np.repeat(np.arange(len(sizes)), np.maximum(sizes - WINDOW + 1, 0))
        first = np.repeat(starts, np.maximum(sizes - WINDOW + 1, 0))
        before = np.repeat(np.cumsum(np.maximum(sizes - WINDOW + 1, 0)) - np.maximum(sizes - WINDOW + 1, 0), np.maximum(sizes - WINDOW + 1, 0))
        p = first + np.arange(len(text)) - before
        if not len(p):
            return empty, empty, empty, empty, empty
        a = anchor[p]
        cut = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (text[1:] != text[:-1])])
        lo, hi = p[cut], p[np.r_[cut[1:], len(p)] - 1]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(v * _powers(_BASE, n), out=sums[1:])
        back = _powers(pow(_BASE, -1, 1 << 64), n + 1)
        content = (sums[hi + WINDOW] - sums[lo]) * back[lo]
        content = _spread(content ^ ((hi - lo).astype(np.uint64) << np.uint64(32)) ^ (a[cut] - lo).astype(np.uint64))
    t = text[cut]
    return t, lo - starts[t], hi - starts[t], gram[a[cut]].view(np.int64), content.view(np.int64)


_PIECES = pa.schema([("ah", pa.int64()), ("sh", pa.int64()), ("doc", pa.int64()), ("rid", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("kind", pa.int8())])
_PIECES_SQL = "ah long, sh long, doc long, rid long, lo long, hi long, kind byte"
MEET, GONE, EDGE = 0, 1, 2


def _parts(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Batches of (doc, rid, place, bytes) of about ``PART`` bytes; a longer text comes in overlapping parts."""
    held: list[tuple[int, int, int, bytes]] = []
    size = 0
    for doc, rid, text in rows:
        for at in range(0, max(1, len(text) - WINDOW + 1), PART):
            part = text[at : at + PART + WINDOW - 1]
            held.append((doc, rid, at, part))
            size += len(part)
            if size >= PART:
                yield held
                held, size = [], 0
    if held:
        yield held


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for b in shared.slices(batches, "text"):
            yield from zip(b.column(1).fill_null(int(_FROM)).to_pylist(), b.column(0).to_pylist(), (t or b"" for t in shared.texts(b, "text")), strict=True)

    for part in _parts(rows()):
        sizes = np.array([len(x[3]) for x in part], np.int64)
        flat = np.frombuffer(b"".join(x[3] for x in part), np.uint8)
        t, lo, hi, ah, sh = segments(flat, np.cumsum(sizes) - sizes, sizes)
        doc, rid, at = (np.array([x[i] for x in part], np.int64) for i in range(3))
        doc, rid, lo, hi = doc[t], rid[t], lo + at[t], hi + at[t]
        # of equal segments in this batch all but the earliest are settled
        order = np.lexsort((lo, rid, doc, sh, ah))
        s, a = sh[order], ah[order]
        again = order[1:][(s[1:] == s[:-1]) & (a[1:] == a[:-1])]
        kind = np.full(len(t), MEET, np.int8)
        kind[again] = GONE
        yield shared.table({"ah": ah, "sh": sh, "doc": doc, "rid": rid, "lo": lo, "hi": hi, "kind": kind}, _PIECES)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, content and place: repeats of a content are gone, contents that meet others are edges."""
    for b in whole_groups(batches, "ah"):
        ah, sh = b.column(0).to_numpy(), b.column(1).to_numpy()
        new = np.r_[True, ah[1:] != ah[:-1]]
        fresh = new | np.r_[True, sh[1:] != sh[:-1]]
        group = np.cumsum(new) - 1
        several = np.bincount(group, fresh)[group] > 1
        kind = np.where(~fresh, GONE, np.where(several, EDGE, MEET)).astype(np.int8)
        use = pa.array(np.flatnonzero(kind != MEET))
        if len(use):
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(use) for i in range(6)), pa.array(kind).take(use)], schema=_PIECES)


class BlindTrie:
    """Orders strings of one length that share a prefix; inner nodes keep only the place where their children part."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list = [0]  # a leaf: numbers of equal strings
        for i in range(1, len(strings)):
            self._insert(i)

    def _insert(self, i: int) -> None:
        s, node = self.strings[i], self.root
        while type(node) is tuple:  # blindly down: only the places of parting are looked at
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = self.strings[node[0]]
        if s == other:
            node.append(i)
            return
        size = len(s)
        x = int.from_bytes(s, "big") ^ int.from_bytes(other, "big")
        at = size - (x.bit_length() + 7) // 8  # the first byte that differs
        node, up = self.root, None
        while type(node) is tuple and node[0] < at:
            up, node = node, node[1][s[node[0]]]
        if type(node) is tuple and node[0] == at:
            node[1][s[at]] = [i]
            return
        new = (at, {other[at]: node, s[at]: [i]})
        if up is None:
            self.root = new
        else:
            up[1][s[up[0]]] = new

    def groups(self) -> list[list[int]]:
        """Equal strings together, in ascending order."""
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if type(node) is tuple:
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                out.append(node)
        return out


def sort_suffixes(flat: bytes, starts: np.ndarray, group: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by group and first ``window`` bytes, and whether each equals the one before it.

    ``flat`` ends with ``window`` bytes more than any suffix needs.
    """
    n = len(starts)
    data = np.frombuffer(flat, np.uint8)
    order = np.argsort(group, kind="stable")
    cut = np.r_[True, group[order][1:] != group[order][:-1]] if n else np.empty(0, bool)
    for depth in range(0, SHALLOW, 8):  # multikey quicksort: sort each group of equals by its next word
        size = np.diff(np.r_[np.flatnonzero(cut), n])
        open_ = np.repeat(size > 1, size)
        if not open_.any():
            break
        rows = order[open_]
        word = np.zeros(len(rows), np.uint64)
        for j in range(8):
            word = (word << np.uint64(8)) | data[starts[rows] + depth + j].astype(np.uint64)
        run = np.repeat(np.arange(len(size)), size)[open_]
        by = np.lexsort((word, run))
        order[open_] = rows[by]
        word, run = word[by], run[by]
        at = np.flatnonzero(open_)
        cut[at] |= np.r_[True, (word[1:] != word[:-1]) | (run[1:] != run[:-1])]
    same = np.zeros(n, bool)
    bounds = np.r_[np.flatnonzero(cut), n]
    size = np.diff(bounds)
    for lo, m in zip(bounds[:-1][size > 1].tolist(), size[size > 1].tolist(), strict=True):
        rows = order[lo : lo + m].tolist()
        strings = [flat[k + SHALLOW : k + window] for k in starts[rows].tolist()]
        if m == 2:
            if strings[0] == strings[1]:
                same[lo + 1] = True
            elif strings[0] > strings[1]:
                order[lo : lo + 2] = rows[::-1]
            continue
        at = lo
        for g in BlindTrie(strings).groups():
            order[at : at + len(g)] = [rows[i] for i in g]
            same[at + 1 : at + len(g)] = True
            at += len(g)
    return order, same


_CUTS = pa.schema([("ah", pa.int64()), ("doc", pa.int64()), ("rid", pa.int64()), ("lo", pa.int64()), ("bytes", pa.binary())])
_GONE = pa.schema([("rid", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])


class _Ranges:
    """Rows of :func:`shared.write_by_part` for the texts of a batch; the last partition stays in memory."""

    def __init__(self, path: tuple[str, int], columns: tuple[str, ...]):
        self.path, self.columns, self.part, self.rid, self.rows = path, columns, None, None, ()

    def of(self, rid: int) -> list[np.ndarray]:
        """The columns' values for one text."""
        if rid >> 33 != self.part:
            self.part, t = rid >> 33, shared.read_part(self.path, rid >> 33)
            self.rid = np.empty(0, np.int64) if t is None else t.column("rid").to_numpy()
            self.rows = [np.empty(0, np.int64) if t is None else t.column(c).to_numpy() for c in self.columns]
        lo, hi = np.searchsorted(self.rid, [rid, rid + 1])
        return [x[lo:hi] for x in self.rows]


def _cut(path: tuple[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _Ranges(path, ("ah", "doc", "lo", "hi"))
        for b in shared.slices(batches, "text"):
            rows: list[tuple] = []
            for rid, text in zip(b.column(0).to_pylist(), shared.texts(b, "text"), strict=True):
                for ah, doc, lo, hi in zip(*(x.tolist() for x in edges.of(rid)), strict=True):
                    rows.append((ah, doc, rid, lo, text[lo : hi + WINDOW]))
            if rows:
                yield shared.table(dict(zip(_CUTS.names, map(list, zip(*rows, strict=True)), strict=True)), _CUTS)

    return run


def _merge(rid: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint byte ranges that touch nowhere, in order of row and place."""
    if not len(rid):
        return rid, s, e
    order = np.lexsort((s, rid))
    rid, s, e = rid[order], s[order], e[order]
    new = np.r_[True, rid[1:] != rid[:-1]]
    run = np.cumsum(new) - 1
    # the furthest end so far within a row
    shift = run * (int(e.max()) + 1)
    far = np.maximum.accumulate(e + shift) - shift
    cut = np.flatnonzero(new | np.r_[True, s[1:] > far[:-1]])
    return rid[cut], s[cut], far[np.r_[cut[1:], len(rid)] - 1]


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in whole_groups(batches, "ah"):
        at = _bounds(b.column(0).to_numpy())
        lo = 0
        while lo < len(at) - 1:  # some groups at a time, one at least
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + 4000, side="right")) - 1)
            part = b.slice(at[lo], at[hi] - at[lo])
            ah, doc, rid, first = (part.column(i).to_numpy() for i in range(4))
            raw = part.column(4).to_pylist()
            sizes = np.array([len(x) for x in raw], np.int64)
            n = sizes - WINDOW + 1
            seg = np.repeat(np.arange(len(raw)), n)
            off = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
            group = np.cumsum(np.r_[True, ah[1:] != ah[:-1]]) - 1
            # the order among equals is the order of the suffixes: earliest first
            by = np.lexsort((first[seg] + off, rid[seg], doc[seg], group[seg]))
            seg, off = seg[by], off[by]
            order, same = sort_suffixes(b"".join(raw) + b"\0" * WINDOW, (np.cumsum(sizes) - sizes)[seg] + off, group[seg])
            run = np.cumsum(~same) - 1
            earliest = np.full(int(run[-1]) + 1, len(order))
            np.minimum.at(earliest, run, order)
            gone = order[order != earliest[run]]
            place = first[seg[gone]] + off[gone]
            r, s, e = _merge(rid[seg[gone]], place, place + WINDOW)
            if len(r):
                yield shared.table({"rid": r, "s": s, "e": e}, _GONE)
            lo = hi


_WINDOWS = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("doc", pa.int64()), ("rid", pa.int64()), ("lo", pa.int64())])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of each segment, by its hash."""
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            b = whole.slice(at, 2048)
            raw = b.column(4).to_pylist()
            n = np.array([len(x) - WINDOW + 1 for x in raw], np.int64)
            h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x[i : i + WINDOW]) for x in raw for i in range(len(x) - WINDOW + 1)), "<i8").reshape(-1, 2)
            off = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            yield shared.table({"w1": h[:, 0], "w2": h[:, 1], "doc": np.repeat(b.column(1).to_numpy(), n), "rid": np.repeat(b.column(2).to_numpy(), n), "lo": np.repeat(b.column(3).to_numpy(), n) + off}, _WINDOWS)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of repeats, joined where they touch within a batch."""
    for b in batches:
        r, s, e = _merge(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy() + WINDOW)
        yield shared.table({"rid": r, "s": s, "e": e}, _GONE)


_KEPT = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())])


def _remove(path: tuple[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone = _Ranges(path, ("s", "e"))
        for b in shared.slices(batches, "text"):
            rows = []
            for rid, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), shared.texts(b, "text"), strict=True):
                text, (s, e) = text or b"", gone.of(rid)
                _, s, e = _merge(np.zeros(len(s), np.int64), s, e)
                spans = [[int(i), int(j)] for i, j in zip(s, e, strict=True)]
                kept, at = [], 0
                for i, j in spans:
                    kept.append(text[at:i])
                    at = j
                kept = b"".join([*kept, text[at:]])
                rows.append((rid, doc, len(text), len(text) - len(kept), spans, kept))
            yield shared.table(dict(zip(_KEPT.names, map(list, zip(*rows, strict=True)), strict=True)), _KEPT)

    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every byte that a 100-byte string covers which also starts earlier.

    Earlier means: in a row with a smaller id (null ids first, equal ids in the
    order of the rows), or at a smaller place of the same text.  All strings are
    judged on the input.  Returns for each row: rid, doc_id, ``n_bytes``,
    ``n_removed``, ``spans`` (start and end of each maximal removed run) and
    ``kept`` (binary: a cut may split a character).  Null texts are empty; texts of
    fewer than 100 bytes stay as they are.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    shared.ship(spark)
    x = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows, _ = shared.write(x, "repeat-docs")
    pieces, pieces_at = shared.write(rows.mapInArrow(_split, _PIECES_SQL), "repeat-pieces")
    order = ("ah", "sh", "doc", "rid", "lo")
    met = pieces.filter(F.col("kind") == MEET).repartition("ah").sortWithinPartitions(*order).mapInArrow(_meet, _PIECES_SQL)
    met, _ = shared.write(met, "repeat-met")
    whole = pieces.filter(F.col("kind") == GONE).select("rid", "lo", "hi").mapInArrow(_near, "rid long, s long, e long")
    whole, _ = shared.write(whole, "repeat-whole")
    shared.remove(spark, pieces_at)

    edges = shared.write_by_part(met.filter(F.col("kind") == EDGE).select("rid", "ah", "doc", "lo", "hi"), "repeat-edges", rows)
    cuts = rows.select("rid", "text").mapInArrow(_cut(edges), "ah long, doc long, rid long, lo long, bytes binary")
    many = met.filter(F.col("kind") == EDGE).groupBy("ah").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("ah")
    many, _ = shared.write(many, "repeat-hot")
    n_hot = many.count()
    if n_hot:
        cuts, cuts_at = shared.write(cuts, "repeat-cuts")
        by = F.broadcast(many) if n_hot <= 1_000_000 else many  # 8 bytes each
        windows = cuts.join(by, "ah", "left_semi").select("ah", "doc", "rid", "lo", "bytes").mapInArrow(_windows, "w1 long, w2 long, doc long, rid long, lo long")
        windows, windows_at = shared.write(windows, "repeat-windows")
        first = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc", "rid", "lo")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("w1", "w2", "first")
        again = shared.to_rows(windows, first, ["w1", "w2"]).filter(F.col("first").isNotNull() & (F.struct("doc", "rid", "lo") != F.col("first")))
        spread, _ = shared.write(again.select("rid", "lo", F.col("lo").alias("hi")).mapInArrow(_near, "rid long, s long, e long"), "repeat-spread")
        whole = whole.unionByName(spread)
        shared.remove(spark, windows_at)
        cuts = cuts.join(by, "ah", "left_anti").select("ah", "doc", "rid", "lo", "bytes")
    sorted_ = cuts.repartition("ah").sortWithinPartitions("ah").mapInArrow(_sort, "rid long, s long, e long")
    again = met.filter(F.col("kind") == GONE).select("rid", F.col("lo").alias("s"), (F.col("hi") + WINDOW).alias("e"))
    gone = shared.write_by_part(whole.unionByName(again).unionByName(sorted_), "repeat-gone", rows)
    if n_hot:
        shared.remove(spark, cuts_at)
    return rows.mapInArrow(_remove(gone), "rid long, doc_id long, n_bytes long, n_removed long, spans array<array<long>>, kept binary")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the removal of repeated passages leaves of every document."""
    x = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return x.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
