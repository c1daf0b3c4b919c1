"""Quality rules with risk-controlled thresholds.

Each document gets counts of its words, symbols, repeated lines and repeated
word windows.  A rule says that a ratio of these is too high.  The cutoffs of all
rules are chosen together, per stratum, from labelled documents.  One half
proposes a sequence of joint cutoffs, from the most careful (far beyond anything
that a good document has) to the boldest (the 99.5 % points of the good ones).
The other half, the holdout, tests them in that order: a joint cutoff passes if an
exact binomial test rejects that more than ``risk`` of the good documents lie
beyond any of its cutoffs; the last one before the first failure is taken.

The order is fixed before the holdout is looked at, so testing in it needs no
correction; between the strata the level is divided by the number of strata
that are large enough to pass at all (Bonferroni; that depends on their sizes
only).  So with probability 1 - ``level`` at least, in no stratum more than
``risk`` of the good documents are rejected by the rules.  A stratum with too
few labels gets no cutoffs, and its rules reject nothing: at the defaults and
four strata it takes 86 good holdout documents.

Strata are rows of tables throughout, joined and never collected, so a dirty
column with a million values costs a row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

RISK, LEVEL = 0.05, 0.05
#: Characters counted as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
#: Rule: ratio of two counts, too high beyond the cutoff.
RULES = {
    "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "marks": ("n_marks", "n_words"),
    "long_words": ("word_chars", "n_words"),
}
#: Joint cutoffs, careful first: multiples of the proposing half's largest ratio (of ``LEAST``, where that is less) ...
TIMES, LEAST = (8.0, 4.0, 2.0, 1.5, 1.25), 0.01
#: ... then shares of its good documents that lie below.
SHARES = (1.0, 0.9995, 0.999, 0.998, 0.997, 0.995)
STEPS = len(TIMES) + len(SHARES)
#: Strata up to which their table is broadcast; some 700 bytes each.
FEW = 10_000
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")


def repeated(words: list[bytes]) -> int:
    """Words that lie in a 3-word window that is found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    m = len(seen)
    if m == n:
        return 0
    key = ids[:-2] * m + ids[1:-1]
    if m > 1 << 20:
        key = np.unique(key, return_inverse=True)[1].astype(np.int64)
    key = key * m + ids[2:]
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    often = np.zeros(n - 2, bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    mark = np.zeros(n, bool)
    for i in range(3):
        mark[i : n - 2 + i] |= often
    return int(mark.sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    """The counts of :data:`_COUNTS`; none for a null text."""
    if not text:
        return (0,) * len(_COUNTS)
    raw = text.encode()
    words = raw.split()  # bytes split at the six ASCII white-space characters exactly
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    marks = raw.count(b"!") + raw.count(b"?")
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated(words), len(lines), capitals(text), marks


def capitals(text: str) -> int:
    """Characters, of any script, that lowering changes."""
    low = text.lower()
    if len(low) != len(text):
        return sum(c != c.lower() for c in text)
    return int((np.frombuffer(text.encode("utf-32-le"), "<u4") != np.frombuffer(low.encode("utf-32-le"), "<u4")).sum())


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("stratum", pa.string()), *((c, pa.int64()) for c in _COUNTS)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in shared.slices(batches, "text"):
        rows = np.array([counts_of(t) for t in b.column(2).to_pylist()], np.int64)
        yield shared.table({"doc_id": b.column(0), "stratum": b.column(1)} | {c: rows[:, i] for i, c in enumerate(_COUNTS)}, _SCHEMA)


def measure(docs: DataFrame, *, stratum_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, stratum and the counts of every whole text."""
    shared.ship(docs.sparkSession)
    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), F.col(text_col).cast("string").alias("text"))
    return x.mapInArrow(_count, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in _COUNTS))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), summed exactly in logarithms."""
    if k >= n:
        return 1.0
    if k >= n * p:  # never small enough to matter, and long to sum
        return 1.0
    top = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p) for i in range(k, -1, -1)]
    return min(1.0, sum(map(exp, top)))


def _ratio(rule: str) -> F.Column:
    a, b = RULES[rule]
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def least_holdout(risk: float, level: float) -> int:
    """Good holdout documents with which a cutoff that rejects none of them passes."""
    return ceil(log(level) / log1p(-risk))


def passed(beyond: list[int], n: int, risk: float, level: float) -> int:
    """How many joint cutoffs pass, in order, before the first that fails."""
    k = 0
    while k < len(beyond) and binomial_tail(beyond[k], n, risk) <= level:
        k += 1
    return k


_CHOSEN = pa.schema([("stratum", pa.string()), ("step", pa.int32())])


def _choose(risk: float, level: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            yield shared.table({"stratum": b.column(0), "step": [passed([r[f"b{i}"] for i in range(STEPS)], r["n"], risk, level) for r in rows]}, _CHOSEN)

    return run


def _join(rows: DataFrame, strata: DataFrame, how: str, n: int) -> DataFrame:
    """Join on the stratum, null with null."""
    by = strata.withColumnRenamed("stratum", "its")
    return rows.join(F.broadcast(by) if n <= FEW else by, F.col("stratum").eqNullSafe(F.col("its")), how).drop("its")


def thresholds(counts: DataFrame, labels: DataFrame, *, risk: float = RISK, level: float = LEVEL, id_col: str = "doc_id", good_col: str = "quality") -> tuple[DataFrame, int]:
    """``stratum``, ``step`` (joint cutoffs passed) and a cutoff ``c_<rule>`` for each rule; and the number of rows.

    All labelled documents take part.  Labels that disagree count as not good;
    null ids and null labels are left out.  A stratum without cutoffs has no row.
    """
    lab = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(good_col).alias("good")).dropna().groupBy("doc_id").agg(F.min("good").alias("good"))
    known = counts.join(lab.filter("good = 1"), "doc_id").withColumn("half", F.crc32(F.concat(F.lit("half:"), F.col("doc_id").cast("string"))) % 2)
    known, at = shared.write(known.select("stratum", "half", *(_ratio(r).alias(r) for r in RULES)), "quality-labelled")
    points = F.array(*map(F.lit, SHARES))
    top = known.filter("half = 0").groupBy("stratum").agg(*(F.percentile_approx(r, points, 20000).alias(r) for r in RULES))
    offers = top.select("stratum", *(F.concat(F.array(*(F.greatest(F.col(r)[0], F.lit(LEAST)) * t for t in TIMES)), r).alias(f"o_{r}") for r in RULES))
    offers, offers_at = shared.write(offers, "quality-offers")
    n = offers.count()
    held = _join(known.filter("half = 1"), offers, "inner", n)
    # a cutoff later in the order is never higher, so a document goes from its first step on
    first = F.least(*(F.expr(f"size(filter(o_{r}, c -> c >= {r}))") for r in RULES))
    tests = held.withColumn("first", first).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("first") <= i).alias(f"b{i}") for i in range(STEPS)))
    tests, tests_at = shared.write(tests.filter(F.col("n") >= least_holdout(risk, level)), "quality-tests")
    share = level / max(1, tests.count())
    chosen = tests.mapInArrow(_choose(risk, share), "stratum string, step int").filter("step > 0")
    cuts = _join(chosen, offers, "inner", n).select("stratum", "step", *(F.element_at(f"o_{r}", F.col("step")).alias(f"c_{r}") for r in RULES))
    cuts, _ = shared.write(cuts, "quality-cuts")
    many = cuts.count()
    shared.remove(known.sparkSession, at, offers_at, tests_at)
    return cuts, many


def judge(docs: DataFrame, labels: DataFrame, *, risk: float = RISK, level: float = LEVEL, stratum_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdict of each document.

    Returns doc_id, stratum, the counts, ``base_failed`` (fewer than 50 words, or
    more than half of the words in repeated windows), ``failed`` (names of the
    rules that reject it) and ``kept``.  Null and empty texts have no words and
    fail the base.  Very long texts are counted whole.  Repeated rows are judged
    alike.  Null strata are a stratum of their own; without labels only the base
    counts.  Other columns are ignored, whatever their names.  An empty table
    gives an empty table.
    """
    shared.ship(docs.sparkSession)
    counts, _ = shared.write(measure(docs, stratum_col=stratum_col, id_col=id_col, text_col=text_col), "quality-counts")
    cuts, n = thresholds(counts, labels, risk=risk, level=level)
    failed = F.array_compact(F.array(*(F.when(_ratio(r) > F.col(f"c_{r}"), F.lit(r)) for r in RULES)))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    x = _join(counts, cuts, "left", n).withColumn("base_failed", base).withColumn("failed", failed)
    return x.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).select(*counts.columns, "base_failed", "failed", "kept")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of all documents, cutoffs from all labels."""
    x = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return x.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed", ",").alias("failed_rules"))
