"""Quality classifier by importance resampling.

Two generative models over hashed word n-grams (one and two words, in
``BUCKETS`` buckets) are counted over all documents: the raw one from every text,
the target one from the texts labelled good.  A document's log importance is the
log ratio of the two models for its n-grams.  Adding Gumbel noise, which depends
on the id alone, and taking the largest k keys draws k documents without
replacement with probabilities in proportion to their importance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import numbered
from . import shared

BUCKETS, SHARE, SMOOTH = 10_000, 0.8, 1.0
_words: dict[bytes, int] = {}


def buckets_of(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of each one- and two-word n-gram of the whole lower-cased text; marks at a word's end count as words."""
    parts = (text or "").lower().encode().split()
    if not parts:
        return np.empty(0, np.int64)
    if len(_words) > 500_000:
        _words.clear()
    get, hashes = _words.get, []
    for w in parts:
        if (h := get(w)) is None:
            stem = w.rstrip(b"!#$%&*+,-./:;<=>?@^_|~")
            h = _words[w] = (xxhash.xxh3_64_intdigest(stem), xxhash.xxh3_64_intdigest(w[len(stem) :]))
        hashes.append(h)
    h = np.array(hashes, np.uint64)
    with np.errstate(over="ignore"):
        x = h[:, 0] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
        two = (x[:-1] ^ (x[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + x[1:]
        marks = h[:, 1][h[:, 1] != np.uint64(xxhash.xxh3_64_intdigest(b""))]
    out = np.concatenate([x, two, marks])
    return ((out ^ (out >> np.uint64(31))) % np.uint64(buckets)).astype(np.int64)


_COUNTS = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("good", pa.int64())])


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in shared.slices(batches, "text"):
            for text, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = np.bincount(buckets_of(text, buckets), minlength=buckets)
                raw += n
                if g:
                    good += n
        use = np.flatnonzero(raw)
        yield shared.table({"bucket": use.astype(np.int32), "raw": raw[use], "good": good[use]}, _COUNTS)

    return run


def mark_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", good_col: str = "quality", most: int = 1_000_000) -> DataFrame:
    """``docs`` with ``_good``: labelled 1, never otherwise.  Up to ``most`` ids (8 bytes each) are broadcast, more are joined."""
    lab = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(good_col).alias("g")).dropna().groupBy("_id").agg(F.min("g").alias("g")).filter("g = 1").select("_id", F.lit(True).alias("_good"))
    if lab.count() <= most:
        lab = F.broadcast(lab)
    docs = docs.drop("_good", "_id")
    return docs.join(lab, docs[id_col].cast("long") == F.col("_id"), "left").drop("_id").withColumn("_good", F.coalesce("_good", F.lit(False)))


def ratios(docs: DataFrame, labels: DataFrame, *, buckets: int = BUCKETS, text_col: str = "text") -> np.ndarray:
    """Log ratio of target to raw probability of each bucket, from all documents; zeros where nothing is labelled good."""
    shared.ship(docs.sparkSession)
    x = mark_good(docs, labels).select(F.col(text_col).cast("string").alias("text"), "_good")
    # a task sends at most a row per bucket; the sums are combined again before the shuffle
    n = x.mapInArrow(_count(buckets), "bucket int, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toArrow()
    raw, good = np.zeros(buckets), np.zeros(buckets)
    at = n.column("bucket").to_numpy()
    raw[at], good[at] = n.column("raw").to_numpy(), n.column("good").to_numpy()
    if not good.sum():
        return np.zeros(buckets)
    p = (raw + SMOOTH) / (raw + SMOOTH).sum()
    # the target is smoothed towards the raw model, so a bucket that is rare in both says nothing
    q = (good + SMOOTH * buckets * p) / (good + SMOOTH * buckets * p).sum()
    return np.log(q) - np.log(p)


_SCORED = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_ngrams", pa.int64()), ("log_ratio", pa.float64())])


def _score(log_ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.slices(batches, "text"):
            n, s = [], []
            for text in b.column(2).to_pylist():
                x = buckets_of(text, len(log_ratio))
                n.append(len(x))
                s.append(float(np.round(log_ratio[x].sum(), 6)))
            yield shared.table({"rid": b.column(0), "doc_id": b.column(1), "n_ngrams": np.array(n, np.int64), "log_ratio": np.array(s)}, _SCORED)

    return run


def score(docs: DataFrame, labels: DataFrame, *, seed: int = 0, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, doc_id, n_ngrams, log_ratio and the Gumbel key of each row."""
    log_ratio = ratios(docs, labels, buckets=buckets, text_col=text_col)
    x = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    x = x.mapInArrow(_score(log_ratio), "rid long, doc_id long, n_ngrams long, log_ratio double")
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return x.withColumn("gumbel_key", F.col("log_ratio") - F.log(-F.log(u)))


def top_k(scored: DataFrame, k: int, key: str = "gumbel_key", bins: int = 4096, rest: int = 10_000) -> DataFrame:
    """``scored`` with ``kept``: exactly the k rows that come first by key (descending), doc_id and rid.

    The k-th largest key is closed in on by histograms, however many rows there
    are; only the last bin's few rows, or equal keys, are ordered, and many equal keys by ranges.
    """
    total = scored.count()
    if k >= total or not total:
        return scored.withColumn("kept", F.lit(k > 0))
    lo, hi = scored.agg(F.min(key), F.max(key)).first()
    above, inside = 0, total
    while inside > rest and hi > lo:
        width = (hi - lo) / bins
        if not lo + width > lo:
            break
        b = F.least(F.floor((F.col(key) - lo) / width), F.lit(bins - 1))
        hist = scored.filter(F.col(key).between(lo, hi)).groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).orderBy(F.desc("b")).collect()
        for row in hist:  # at most `bins` rows
            if above + row.n >= k:
                lo, hi, inside = row.lo, row.hi, row.n
                break
            above += row.n
    band, order = scored.filter(F.col(key).between(lo, hi)).select(key, "doc_id", "rid"), [F.desc(key), F.asc_nulls_first("doc_id"), "rid"]
    band = band.orderBy(*order).limit(k - above) if inside <= rest else numbered(band, order).filter(F.col("rank") <= k - above)
    band = band.select("rid", F.lit(True).alias("_in"))
    x = scored.join(band, "rid", "left")
    return x.withColumn("kept", (F.col(key) > hi) | F.coalesce("_in", F.lit(False))).drop("_in")


def resample(docs: DataFrame, labels: DataFrame, *, share: float = SHARE, k: int | None = None, seed: int = 0, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Draw ``k`` rows (or the ``share`` of all rows) by importance.

    Returns rid, doc_id, n_ngrams, log_ratio, gumbel_key and ``kept``.  Texts
    without words (null, empty) have log ratio 0 and compete like any other; rows
    with equal ids share their noise, and ties go to the smaller id, nulls first.
    Labels that are null or disagree are not good; with none good all ratios are
    0 and the draw is uniform.  An empty table gives an empty table.
    """
    scored, _ = shared.write(score(docs, labels, seed=seed, buckets=buckets, id_col=id_col, text_col=text_col), "resample-scored")
    return top_k(scored, int(round(share * scored.count())) if k is None else k)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance and draw of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("rid")
