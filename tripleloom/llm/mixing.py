"""Mixing to target weights with soft membership.

A classifier fitted on the labelled table gives each document a posterior over
domains; then a nonnegative rate per document is fitted so that the expected
tokens of each domain (rate x tokens x posterior, summed) meet the targets.

Everything is DataFrame expressions.  The classifier is naive Bayes over the
presence and absence of hashed words and hashed word endings; buckets that do
not tell the domains apart significantly have no weight.

The fit is projected gradient descent on the squared misfit m' W m, where m is the
misfit of the domains' tokens and W the inverse of their Gram matrix G at rate 1
(the sum of tokens x posterior x posterior'), which puts scarce and frequent domains
on one scale.  In rates weighted by tokens this objective has curvature 1 at most, so the
step of length 1 is safe: the misfit never grows, and where the iteration stands
still the rates are the nonnegative least squares solution.  A step moves a document's rate by
posterior . (W m), then cuts it off at 0; so rates are a closed expression of a
few numbers per step, and documents with equal posteriors have equal rates:
tokens are summed by posterior once, and a step is one aggregate over that
table.  Cut-off rates make room for longer steps, so the same aggregate tries lengths
up to 8,192 and the one with the least misfit is taken.  W is fixed; it is not the Newton step's matrix, which changes with the
documents at rate 0 and has other fixed points.

Where the documents left have little of a domain, W is far too small for it and such
steps crawl.  A step that leaves over half of the misfit gives way to an implicit
one: of a length L much longer than 1, against the gradient at its own end (the step s
with s = L W m', m' the misfit after it).  It moves a rate as all steps do, has the
same fixed points for any L > 0 (the rates are their own projected gradient step), and
never raises the misfit, for it minimizes m' W m + |change|^2 / L.  The step s is the minimum
of a convex function of as many numbers as there are domains, found by damped
Newton steps, an aggregate each.
"""

from __future__ import annotations

import json
from math import log, sqrt

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Share of the tokens that each domain is to have.
TARGETS = {"clean": 0.94, "junk": 0.05, "toxic": 0.01}
WORD_BUCKETS, END_BUCKETS, Z, STEPS, CLOSE, STILL = 1 << 15, 1 << 11, 4.0, 100, 1e-6, 1e-4
#: Step lengths tried together; the first is safe.
LENGTHS = tuple(2.0**i for i in range(14))
#: Lengths of the first implicit step and of the longest, and what each is longer than the one before; dampings tried together, and Newton steps.
FAR, FARTHEST, FARTHER, DAMPED, NEWTON = 1e5, 1e11, 100.0, (1.0, 0.5, 0.25, 0.0625, 2.0**-6, 2.0**-9), 60
#: With a domain to be used whole: bound on a scarce domain's repeats, if its documents hold this share of its tokens as their own.
REPEATS, OWN = 16, 0.5
_SPLIT = r"[\x20\x09-\x0D]+"


def domain_of() -> F.Column:
    """The domain that the labels state: toxic before junk before clean."""
    return F.when(F.col("toxic") == 1, F.lit("toxic")).when(F.col("quality") == 0, F.lit("junk")).when(F.col("quality") == 1, F.lit("clean"))


def _words(text: F.Column) -> F.Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPLIT), lambda w: w != "")


def _features(w: F.Column) -> tuple[F.Column, F.Column]:
    """Buckets of a word and of its ending, counted on from the words' buckets."""
    word = F.pmod(F.xxhash64(F.lower(w)), F.lit(WORD_BUCKETS))
    end = F.pmod(F.xxhash64(F.right(w, F.lit(2))), F.lit(END_BUCKETS)) + WORD_BUCKETS
    return word, end


def _buckets(text: F.Column) -> F.Column:
    """Distinct buckets of a text, counted from 1."""
    return F.array_distinct(F.flatten(F.transform(F.array_distinct(_words(text)), lambda w: F.array(*((f + 1).cast("int") for f in _features(w))))))


def with_domain(docs: DataFrame, labels: DataFrame, most: int = 300_000) -> DataFrame:
    """Labelled documents with ``_domain``; labels of an id that disagree take the worst."""
    rank = F.min(F.when(F.col("d") == "toxic", 0).when(F.col("d") == "junk", 1).otherwise(2)).alias("r")
    lab = labels.select(F.col("doc_id").cast("long").alias("_id"), domain_of().alias("d")).dropna().groupBy("_id").agg(rank)
    lab = lab.select("_id", F.element_at(F.array(*map(F.lit, ("toxic", "junk", "clean"))), F.col("r") + 1).alias("_domain"))
    if lab.count() <= most:  # some 50 bytes each; beyond that both sides are shuffled
        lab = F.broadcast(lab)
    return docs.join(lab, docs["doc_id"].cast("long") == F.col("_id")).drop("_id")


def fit_classifier(docs: DataFrame, labels: DataFrame, domains: list[str]) -> tuple[list[float], list[list[float]]]:
    """Log prior and weights of each domain but the first, against the first; from all labelled documents."""
    known = with_domain(docs.select("doc_id", "text"), labels)
    n_docs = {r["_domain"]: r["n"] for r in known.groupBy("_domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = WORD_BUCKETS + END_BUCKETS
    if any(d not in n_docs for d in domains):
        present = [d for d in domains if d in n_docs]
        if not present:
            return [0.0] * (len(domains) - 1), [[0.0] * size for _ in domains[1:]]
    counts = {d: [0] * size for d in domains}
    words = known.select("_domain", F.explode(_buckets(F.col("text"))).alias("b"))
    for r in words.groupBy("_domain", "b").agg(F.count(F.lit(1)).alias("n")).collect():  # at most domains x buckets rows
        counts[r["_domain"]][r["b"] - 1] = r["n"]
    prior, weights = [], []
    base, n0 = counts[domains[0]], n_docs.get(domains[0], 0)
    for d in domains[1:]:
        own, n1 = counts[d], n_docs.get(d, 0)
        # a domain that no label states has no posterior
        start, out = log((n1 + 1) / (n0 + 1)) + 1000.0 * ((n0 == 0) - (n1 == 0)), []
        for a, b in zip(own, base, strict=True):
            p, q = (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1)
            # from the counts as they are: smoothed ones tell a scarce domain apart by buckets that nobody has
            both = (a + b) / max(n0 + n1, 1)
            z = (a / n1 - b / n0) / sqrt(both * (1 - both) * (1 / n0 + 1 / n1)) if n0 and n1 and 0 < both < 1 else 0.0
            if abs(z) > Z:
                start += log((1 - p) / (1 - q))  # as if absent; presence takes this back
                out.append(log(p / q) - log((1 - p) / (1 - q)))
            else:
                out.append(0.0)
        prior.append(start)
        weights.append(out)
    return prior, weights


def posteriors(docs: DataFrame, prior: list[float], weights: list[list[float]], domains: list[str]) -> DataFrame:
    """``docs`` (no column of which may start with an underscore) with ``_n`` (words) and ``_p`` (array of posteriors in the domains' order)."""
    table = [F.from_json(F.lit("[" + ",".join(f"{x:.6g}" for x in w) + "]"), "array<double>") for w in weights]
    def weigh(at: F.Column, start: float) -> F.Column:
        return F.aggregate("_f", F.lit(start), lambda a, i: a + F.element_at(at, i))

    # each step is a column of its own, so that a text is split and hashed once
    x = docs.withColumn("_w", _words(F.col("text")))
    x = x.withColumn("_n", F.size("_w").cast("long")).withColumn("_d", F.array_distinct("_w")).drop("_w")
    x = x.withColumn("_f", F.array_distinct(F.flatten(F.transform("_d", lambda w: F.array(*((f + 1).cast("int") for f in _features(w))))))).drop("_d")
    x = x.withColumn("_l", F.array(F.lit(0.0), *(weigh(t, float(p0)) for p0, t in zip(prior, table, strict=True)))).drop("_f")
    e = F.transform("_l", lambda v: F.exp(v - F.array_max("_l")))
    x = x.withColumn("_e", e)
    total = F.aggregate("_e", F.lit(0.0), lambda a, v: a + v)
    return x.withColumn("_p", F.transform("_e", lambda v: F.round(v / total, 6))).drop("_e", "_l")


def rate_after(steps: list[list[float]], start: F.Column | None = None) -> F.Column:
    """The rate after these steps: each moves against the gradient and projects onto the nonnegative numbers."""
    r = F.lit(1.0) if start is None else start
    if not steps:
        return r
    table = F.from_json(F.lit(json.dumps(steps)), "array<array<double>>")
    move = lambda c: sum((F.element_at("_p", i + 1) * F.element_at(c, i + 1) for i in range(len(steps[0]))), F.lit(0.0))
    return F.aggregate(table, r, lambda r, c: F.greatest(F.lit(0.0), r - move(c)))


class Fit:
    """Steps of the fit, target tokens, the expected tokens before each step and the way it ended ("met" or "still")."""

    def __init__(self, names: list[str], goal: list[float]):
        self.names, self.goal = names, goal
        self.steps: list[list[float]] = []
        self.history: list[list[float]] = []
        self.ended = ""


def goals(targets: dict[str, float], now: list[float], held: list[float], budget: float | None, whole: str | None) -> list[float]:
    """Target tokens of each domain from what there is (``now``) and what its own documents hold."""
    names, k = list(targets), len(targets)
    share = [targets[d] / sum(targets.values()) for d in names]
    once = names.index(whole) if whole in names else -1
    if budget is None and once >= 0 and share[once] and now[once] > 0:
        budget = now[once] / share[once]
    total = budget if budget is not None else min((now[i] / share[i] for i in range(k) if share[i] and now[i] > 0), default=0.0)
    goal = [s * total for s in share]
    if once >= 0:
        most = [a * (REPEATS if m >= OWN * a else 1) for a, m in zip(now, held, strict=True)]
        goal = list(map(min, goal, most))
    return goal


def implicit_step(groups: DataFrame, goal: np.ndarray, gram: np.ndarray, length: float) -> tuple[np.ndarray, np.ndarray]:
    """The step against the gradient at its own end from the rates ``old`` of ``groups(_n, _p, old)``, and the tokens after it.

    With rates r = max(0, old - p . s) the function sum(n r^2) / 2 + goal . s + s' G s / (2 length)
    is convex in s, and its gradient is 0 where s = length W m.
    """
    k = len(goal)
    p = [F.element_at("_p", i + 1) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    pull = gram / length
    scale = 1 / np.sqrt(np.diag(pull))

    def at(steps: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        sums = []
        for c, s in enumerate(steps):
            r = F.greatest(F.lit(0.0), F.col("old") - sum((p[i] * float(s[i]) for i in range(k)), F.lit(0.0)))
            free = F.when(r > 0, F.col("_n")).otherwise(0.0)
            sums += [F.sum(F.col("_n") * r * r).alias(f"f{c}"), *(F.sum(F.col("_n") * r * p[i]).alias(f"t{c}_{i}") for i in range(k)), *(F.sum(free * p[i] * p[j]).alias(f"h{c}_{i}_{j}") for i, j in pairs)]
        row, out = groups.agg(*sums).first(), []
        for c, s in enumerate(steps):
            bend = np.array([[row[f"h{c}_{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
            out.append(((row[f"f{c}"] or 0.0) / 2 + goal @ s + s @ pull @ s / 2, np.array([row[f"t{c}_{i}"] or 0.0 for i in range(k)]), bend))
        return out

    step = np.zeros(k)
    value, totals, bend = at([step])[0]
    for _ in range(NEWTON):
        slope = goal - totals + pull @ step
        if np.abs(slope).max() <= 1e-3 * CLOSE * goal.sum():
            break
        move = -scale * np.linalg.lstsq((bend + pull) * np.outer(scale, scale), scale * slope, rcond=1e-15)[0]
        tried = at([step + t * move for t in DAMPED])
        best = int(np.argmin([f for f, _, _ in tried]))
        if not tried[best][0] < value:
            break
        step, (value, totals, bend) = step + DAMPED[best] * move, tried[best]
    return step, totals


def fit_rates(soft: DataFrame, targets: dict[str, float], budget: float | None = None, steps: int = STEPS, whole: str | None = None) -> Fit:
    """Fit rates to the targets over ``soft(_n, _p)``.

    Without a budget the total is the largest for which no domain would have to be
    repeated as a whole; with ``whole`` it is the one for which that domain is used
    once.  Scarcer domains then are repeated up to ``REPEATS`` times; those that no
    document mostly belongs to, and what is missing beyond that, are left short.

    The fit ends when every domain's tokens are within ``CLOSE`` of all target
    tokens, or when a step lowers the misfit by less than the share ``STILL``
    (targets that no rates meet); ``ArithmeticError`` if neither happens in
    ``steps`` steps.
    """
    k, names = len(targets), list(targets)
    p = [F.element_at("_p", i + 1) for i in range(k)]
    soft, made = shared.write(soft.groupBy("_p").agg(F.sum("_n").cast("double").alias("_n")).withColumn("_r", F.lit(1.0)), "mix-groups")
    tables = [made]
    row = soft.agg(*(F.sum(F.col("_n") * p[i]).alias(f"t{i}") for i in range(k)), *(F.sum(F.col("_n") * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k))).first()
    gram = np.array([[row[f"m{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    now = [row[f"t{i}"] or 0.0 for i in range(k)]
    fit = Fit(names, goals(targets, now, np.diag(gram).tolist(), budget, whole))
    # scaled to a unit diagonal first, so that a scarce domain is not taken for rounding
    d = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    weight = np.linalg.pinv(gram / np.outer(d, d), rcond=1e-9, hermitian=True) / np.outer(d, d)
    since: list[list[float]] = []  # steps that the table of rates does not hold yet
    far, pull = FAR, gram + np.diag(np.where(np.diag(gram) > 0, 0.0, 1.0))
    while True:
        fit.history.append(now)
        miss = np.array(now) - fit.goal
        if np.abs(miss).max() <= CLOSE * max(sum(fit.goal), 1.0):
            fit.ended = "met"
        elif miss @ weight @ miss <= CLOSE**2 * float(np.array(fit.goal) @ weight @ np.array(fit.goal)):
            fit.ended = "still"  # what is missing no rate can change
        elif len(fit.steps) >= steps:
            raise ArithmeticError(f"rates do not settle in {steps} steps: {dict(zip(names, now, strict=True))} for {dict(zip(names, fit.goal, strict=True))}")
        if not fit.ended:
            step = weight @ miss
            old, move = rate_after(since, F.col("_r")), sum((p[i] * float(step[i]) for i in range(k)), F.lit(0.0))
            tried = soft.select("_n", "_p", old.alias("old"), move.alias("move"))
            rates = [F.greatest(F.lit(0.0), F.col("old") - F.col("move") * t) for t in LENGTHS]
            row = tried.agg(*(F.sum(F.col("_n") * r * p[i]).alias(f"t{j}_{i}") for j, r in enumerate(rates) for i in range(k))).first()
            totals = [np.array([row[f"t{j}_{i}"] or 0.0 for i in range(k)]) for j in range(len(LENGTHS))]
            left = [float((t - fit.goal) @ weight @ (t - fit.goal)) for t in totals]
            best = int(np.argmin(left))
            least, step, after = left[best], LENGTHS[best] * step, totals[best]
            was = float(miss @ weight @ miss)
            if least > was / 2:
                longer, end = implicit_step(tried, np.array(fit.goal), pull, far)
                far = min(far * FARTHER, FARTHEST)
                if (over := float((end - fit.goal) @ weight @ (end - fit.goal))) < least:
                    least, step, after = over, longer, end
            if was - least <= STILL * was:
                fit.ended = "still"
            else:
                fit.steps.append(step.tolist())
                since.append(fit.steps[-1])
                now = after.tolist()
        if fit.ended:
            shared.remove(soft.sparkSession, *tables)
            return fit
        if len(since) == 8:
            soft, made = shared.write(soft.withColumn("_r", rate_after(since, F.col("_r"))), "mix-groups")
            tables.append(made)
            since = []


def mix(docs: DataFrame, labels: DataFrame, *, targets: dict[str, float] | None = None, budget: float | None = None, steps: int = STEPS, seed: int = 0, keep: list[str] | None = None, whole: str | None = None) -> DataFrame:
    """The rows with all columns (or those of ``keep``) and ``_n``, ``_p``, ``_rate`` and ``_copies`` (input columns of these names go).

    ``_rate`` is how often the row is to be used; ``_copies`` is the rate rounded
    up or down by the hash of its id, so that its expectation is the rate.
    ``whole`` names a domain to be used once (see :func:`fit_rates`); where no word
    tells the domains apart all rates then are 1.  Null and empty texts have no
    tokens, the prior as posterior, and the rate that goes with it; very long
    texts are read whole.  Rows with equal ids are rounded alike; a null id has a hash
    too.  Without labels all documents have one and the same posterior and the
    rate 1 can only be scaled.  Other columns pass through, whatever their names.
    An empty table gives an empty table.
    """
    targets = targets or TARGETS
    keep = [c for c in docs.columns if c not in ("_n", "_p", "_rate", "_copies")] if keep is None else keep
    # the columns that pass through wait in one of their own, so none of their names matters here
    aside = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"))
    prior, weights = fit_classifier(docs, labels, list(targets))
    soft, _ = shared.write(posteriors(aside, prior, weights, list(targets)).select("doc_id", "row", "_n", "_p"), "mix-posteriors")
    done = [] if whole is not None and not any(map(any, weights)) else fit_rates(soft.select("_n", "_p"), targets, budget, steps, whole).steps
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    x = soft.withColumn("_rate", F.round(rate_after(done), 9))
    x = x.withColumn("_copies", (F.floor("_rate") + (u < F.col("_rate") - F.floor("_rate")).cast("long")).cast("long"))
    return x.select(*(F.col("row").getField(c).alias(c) for c in keep), "_n", "_p", "_rate", "_copies")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior, rate and copies of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    x = mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["doc_id"])
    own = [F.element_at("_p", i + 1).alias(f"p_{d}") for i, d in enumerate(TARGETS)]
    return x.select("doc_id", F.col("_n").alias("n_tokens"), *own, F.col("_rate").alias("rate"), F.col("_copies").alias("copies"))
