import hashlib
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tripleloom.llm import langid, mixing, resampling, shared

BIG = "/root/testdata/sf0.01"


def test_gradients_are_derivatives():
    rng = np.random.default_rng(0)
    net = langid.Network(["a", "b", "c"], 5, seed=1)
    data, target = rng.integers(0, 256, (9, 4)).astype(np.uint8), np.array([0, 1, 2, 1])
    _, g = net.gradients(data, target)
    for name, value in net.p.items():
        at = np.unravel_index(np.abs(g[name]).argmax(), value.shape)
        old, step = value[at], 1e-2
        value[at] = old + step
        up = net.gradients(data, target)[0]
        value[at] = old - step
        down = net.gradients(data, target)[0]
        value[at] = old
        assert (up - down) / (2 * step) == pytest.approx(g[name][at], rel=0.02, abs=1e-4), name


def test_documents_pool_every_position():
    net = langid.Network(["a", "b"], 4, seed=2)
    texts = [b"x" * 5, b"", bytes(range(32, 127)) * 5]
    got = net.documents(texts)
    for t, row in zip(texts, got, strict=True):
        want = np.zeros(2)
        for at in range(0, len(t), langid.SEGMENT):
            part = t[at : at + langid.SEGMENT].ljust(langid.SEGMENT)
            p = net.positions(np.frombuffer(part, np.uint8)[:, None].copy())[:, :, 0]
            want += p[: len(t) - at].sum(0)
        assert row == pytest.approx(want / max(1, len(t)), abs=1e-5)


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    rows = langid.op9_language_id(spark, BIG).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in rows if r.held_out]) > 0.95


def test_language_of_odd_tables(spark, odd, none):
    net = langid.fit(odd, steps=5)
    got = langid.identify(odd, net).collect()
    assert len(got) == odd.count() and {r.n for r in got} == {"clash"}
    assert all(r._lang == "und" and r._score == 0 for r in got if not r.text or not r.text.strip())
    assert langid.fit(none) is None and langid.identify(none, None).count() == 0
    assert {r._lang for r in langid.identify(odd, None).collect()} == {"und"}


def test_pipeline_rejects_texts_in_no_known_language(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    rng = np.random.default_rng(6)
    letters = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    bad = [
        "Быстрая коричневая лиса перепрыгивает через ленивую собаку", "Η γρήγορη καφέ αλεπού πηδάει πάνω από τον τεμπέλη σκύλο", "敏捷的棕色狐狸跳过了懒狗然后离开了森林回家去",
        "الثعلب البني السريع يقفز فوق الكلب الكسول", "Szybki brązowy lis przeskakuje nad leniwym psem i potem wraca do domu", letters(90), " ".join(letters(6) for _ in range(200)),
    ]
    more = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(bad)], "doc_id long, text string")
    x = docs.unionByName(more, allowMissingColumns=True)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, x, BIG).select("doc_id").collect()}
    assert not [bad[i - 10**9] for i in kept if i >= 10**9]
    good = {r.doc_id for r in docs.filter(F.col("text").rlike(r"\p{L}")).select("doc_id").collect()}
    assert len(good - kept) <= 0.002 * len(good)


def brute_ratios(rows, good, buckets=resampling.BUCKETS):
    raw, tgt = np.zeros(buckets), np.zeros(buckets)
    for d, t in rows:
        n = np.bincount(resampling.buckets_of(t, buckets), minlength=buckets)
        raw += n
        tgt += n * (d in good)
    p = (raw + 1) / (raw + 1).sum()
    q = (tgt + buckets * p) / (tgt + buckets * p).sum()
    return np.log(q) - np.log(p)


def test_resampling_equals_brute_force(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    ratio = brute_ratios(rows, good)
    want = {d: ratio[resampling.buckets_of(t)].sum() for d, t in rows}
    got = {r.doc_id: r for r in resampling.resample(docs, labels).collect()}
    assert all(got[d].log_ratio == pytest.approx(w, abs=1e-4) for d, w in want.items())
    first = sorted(got.values(), key=lambda r: (-r.gumbel_key, r.doc_id))[: round(0.8 * len(rows))]
    assert {r.doc_id for r in first} == {d for d, r in got.items() if r.kept}
    kept = lambda q: np.mean([got[r.doc_id].kept for r in labels.collect() if r.quality == q])
    assert kept(1) > 0.9 > 0.5 > kept(0)


@pytest.mark.parametrize("k", [0, 1, 7, 500, 999, 1000, 2000])
def test_top_k_is_exact(spark, k):
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 7), float(x)) for i, x in enumerate(np.r_[rng.normal(size=600), np.full(400, 0.25)])]
    df = spark.createDataFrame(rows, "rid long, doc_id long, gumbel_key double").repartition(3)
    got = {r.rid for r in resampling.top_k(df, k, bins=8, rest=20).filter("kept").collect()}
    want = {r[0] for r in sorted(rows, key=lambda r: (-r[2], r[1], r[0]))[:k]}
    assert got == want


def test_resampling_of_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, None)], "doc_id long, quality int")
    got = resampling.resample(odd, labels).collect()
    assert len(got) == odd.count() and sum(r.kept for r in got) == round(0.8 * len(got)) and {r.log_ratio for r in got} == {0.0}
    assert resampling.resample(none, labels).count() == 0


def brute_rates(n, p, goal, rounds=20000):
    """Nonnegative rates from 1 by projected gradient in numpy, one rate per row, in the metric of the fit."""
    gram = (n[:, None, None] * p[:, :, None] * p[:, None, :]).sum(0)
    w = np.linalg.pinv(gram, hermitian=True)
    r = np.ones(len(n))
    for _ in range(rounds):
        new = np.maximum(0, r - p @ (w @ ((n * r) @ p - goal)))
        if np.abs(new - r).max() < 1e-12:
            break
        r = new
    return r


def test_mixing_meets_its_targets(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.filter("doc_id < 4000")
    x = mixing.mix(docs.select("doc_id", "text"), labels, keep=["doc_id"]).collect()
    names = list(mixing.TARGETS)
    now = np.array([[r._n * r._rate * p for p in r._p] for r in x]).sum(0)
    before = np.array([[r._n * p for p in r._p] for r in x]).sum(0)
    budget = min(before[i] / mixing.TARGETS[d] for i, d in enumerate(names))
    goal = [mixing.TARGETS[d] * budget for d in names]
    assert now == pytest.approx(goal, rel=1e-4)
    want = brute_rates(np.array([r._n for r in x], float), np.array([r._p for r in x]), np.array(goal))
    assert np.array([r._rate for r in x]) == pytest.approx(want, abs=0.05)  # many rates meet the goals; these lie near each other
    assert all(r._rate >= 0 and abs(r._copies - r._rate) < 1 and sum(r._p) == pytest.approx(1, abs=1e-5) for r in x)
    assert sum(r._copies for r in x) == pytest.approx(sum(r._rate for r in x), rel=0.05)
    truth = {r.doc_id: r.d for r in labels.select("doc_id", mixing.domain_of().alias("d")).collect()}
    right = [names[int(np.argmax(r._p))] == truth[r.doc_id] for r in x if r.doc_id in truth]
    assert np.mean(right) > 0.8


@pytest.mark.parametrize("goal", [{"a": 1.0, "b": 0.0}, {"a": 0.7, "b": 0.3}, {"a": 0.999, "b": 0.001}])
def test_rates_are_the_nonnegative_least_squares_solution(spark, goal):
    rng = np.random.default_rng(7)
    p = np.round(rng.beta(0.3, 0.5, 60), 3) * 0.8 + 0.1  # nothing belongs to one domain alone, so extreme targets cannot be met
    p = np.stack([p, 1 - p], 1)
    n = rng.integers(1, 300, 60).astype(float)
    soft = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "_n long, _p array<double>")
    fit = mixing.fit_rates(soft, goal, budget=float(n.sum()))
    got = np.array([r[0] for r in soft.select(mixing.rate_after(fit.steps)).collect()])
    # brute force: for two domains the totals of nonnegative rates fill the cone between the extreme columns
    rate = np.array([r["r"] for r in soft.select("_n", "_p", mixing.rate_after(fit.steps).alias("r")).collect()])
    want = np.array(list(goal.values())) * n.sum()
    gram = (n[:, None, None] * p[:, :, None] * p[:, None, :]).sum(0)
    half = np.linalg.cholesky(np.linalg.inv(gram)).T
    cone = [p[p[:, 0].argmin()], p[p[:, 0].argmax()]]
    best = want
    if not cone[0][0] / cone[0][1] <= want[0] / max(want[1], 1e-300) <= cone[1][0] / cone[1][1]:
        ends = [c * max(0.0, (half @ c) @ (half @ want) / ((half @ c) @ (half @ c))) for c in cone]
        best = min(ends, key=lambda t: np.linalg.norm(half @ (t - want)))
    total = (n * rate) @ p
    assert (got >= 0).all()
    assert np.linalg.norm(half @ (total - want)) == pytest.approx(np.linalg.norm(half @ (best - want)), rel=0.02, abs=1e-4 * np.linalg.norm(half @ want))
    assert fit.ended == ("met" if np.allclose(best, want) else "still")


def test_a_fit_that_does_not_settle_is_an_error(spark):
    soft = spark.createDataFrame([(100, [0.9, 0.1]), (80, [0.6, 0.4]), (50, [0.5, 0.5])], "_n long, _p array<double>")
    with pytest.raises(ArithmeticError):
        mixing.fit_rates(soft, {"a": 1.0, "b": 0.0}, budget=80.0, steps=1)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_rates_settle_where_the_scarce_domain_is_spread_thin(spark, seed):
    """Plain steps are too short for what little of a domain is left once its own documents are at rate 0."""
    rng = np.random.default_rng(seed)
    p = np.exp(rng.normal(0, 4, (300, 3)) + [0, -2, 1])
    p, n = np.round(p / p.sum(1, keepdims=True), 6), rng.integers(1, 300, 300).astype(float)
    soft = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "_n long, _p array<double>")
    for whole in (None, "clean"):
        fit = mixing.fit_rates(soft, mixing.TARGETS, whole=whole)
        rate = np.array([r["r"] for r in soft.select(mixing.rate_after(fit.steps).alias("r")).collect()])
        assert fit.ended == "met" and (rate >= 0).all()
        assert (n * rate) @ p == pytest.approx(fit.goal, abs=2e-6 * sum(fit.goal))


@pytest.mark.parametrize("sizes", [(3796, 200, 4), (1800, 1050, 150)])
def test_pipeline_mixture_of_scarce_and_of_plentiful_domains(spark, tmp_path, sizes):
    rng, names = np.random.default_rng(3), list(mixing.TARGETS)
    kind = rng.permutation(np.repeat(names, sizes))
    text = lambda d: " ".join(f"{d}{chr(97 + a)}" if a < 20 else f"w{a}" for a in rng.integers(0, 40, 40))
    docs = spark.createDataFrame([(i, text(d)) for i, d in enumerate(kind)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(d != "junk"), int(d == "toxic")) for i, d in enumerate(kind)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    ids = [r.doc_id for r in corpus_pipeline.mixture(spark, docs, str(tmp_path)).select("doc_id").collect()]
    copies = dict(zip(*np.unique(ids, return_counts=True), strict=True))
    assert np.mean([copies.get(i) == 1 for i, d in enumerate(kind) if d == "clean"]) > 0.995
    used = [sum(copies.get(i, 0) for i, k in enumerate(kind) if k == d) for d in names]
    for n, d in zip(used, names, strict=True):  # the rest is the draw
        want = mixing.TARGETS[d] * sizes[0] / mixing.TARGETS["clean"]
        assert n == pytest.approx(want, abs=3.5 * want**0.5), d


def test_pipeline_mixture_draws_the_fitted_totals(spark):
    """Domain totals of what the stage returns, by the posteriors of its own classifier, against the goals."""
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    got = corpus_pipeline.mixture(spark, docs, BIG).groupBy("doc_id").count()
    x = mixing.mix(docs.select("doc_id", "text"), labels, keep=["doc_id"], whole="clean").join(got, "doc_id", "left").fillna(0, ["count"]).collect()
    n, p = np.array([r._n for r in x], float), np.array([r._p for r in x])
    rate, used = np.array([r._rate for r in x]), np.array([r["count"] for r in x])
    drawn, meant = (n * used) @ p, (n * rate) @ p
    noise = np.sqrt((((n * (rate - np.floor(rate)) ** 0.5)[:, None] * p) ** 2).sum(0))
    assert (np.abs(drawn - meant) <= 4 * noise + 1).all()
    assert (used == [r._copies for r in x]).all()


def test_mixture_without_what_tells_domains_apart_uses_all(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r._copies for r in mixing.mix(docs, labels, whole="clean").collect()} == {1}


def test_mixing_is_native_and_takes_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 1, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    x = mixing.mix(odd, labels)
    assert x.count() == odd.count() and "Python" not in x._jdf.queryExecution().toString() and "Arrow" not in x._jdf.queryExecution().toString()
    assert all(r._n == 0 for r in x.collect() if not (r.text or "").strip())
    assert {r._w for r in x.collect()} == {"clash"}
    assert mixing.mix(none, labels).count() == 0
    alike = {tuple(r._p) for r in mixing.mix(odd, labels.limit(0)).collect()}
    assert len(alike) == 1


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        was = [(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()]
        before = {d for d, _ in was}
        kept, _ = shared.write(stage(spark, kept, BIG), f"test-{name}")
        assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} <= before
        if name == "lines":
            from test_tokens_lines_quality import brute_lines

            want = {r[1]: r for r in brute_lines(was)}
            left = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in kept.select("doc_id", "text").collect()}
            assert any(r[3] for r in want.values()) and all(want[d][4] == h for d, h in left.items())
            empty = hashlib.sha256(b"").hexdigest()
            assert all(r[3] for d, r in want.items() if d not in left) and not [d for d, r in want.items() if d not in left and r[3] < r[2] and r[4] == empty and not r[3]]
        if name == "near_duplicates":
            from test_near_vectors_suffixes import got_near

            assert all(n == 0 for _, _, n, _ in got_near(kept.select("doc_id", "text")))
        assert kept.filter(F.length("text") != F.col("n_chars")).count() == 0
    pieces = corpus_pipeline.packed(spark, kept, BIG)
    n = pieces.filter("start = 0").count()
    assert n == kept.count()


def test_pipeline_workers_keep_no_tokenizer_beside_other_operators():
    """Workers serve one operator after the other; what the last one kept must not lie beside the next."""
    from tripleloom.llm import linededup, nearjoin, packing, tokens

    path, none = tokens.vocabulary(), iter(())
    with pytest.MonkeyPatch.context() as m:
        m.setattr(packing, "TaskContext", type("Task", (), {"get": classmethod(lambda c: c), "partitionId": classmethod(lambda c: 0)}))
        assert list(packing._encode(path, 2)(none)) == []
    assert tokens.encoder.cache_info().currsize == 1
    for run in (langid._predict(None, "text", []), linededup._hash(40), linededup._probe("", 5), linededup._drop(("", 1), 40, [], "text", "doc_id"), nearjoin._sign(5), nearjoin._bands, nearjoin._short, nearjoin._candidates([]), nearjoin._verify(0.8, 1e-7), nearjoin._sets(5), packing._cut(np.zeros(1, np.int64), 4096)):
        tokens.encoder(path)
        assert list(run(none)) == [] and tokens.encoder.cache_info().currsize == 0


def test_pipeline_of_odd_and_empty_tables(spark, odd, none, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for name, table in (("odd", odd), ("none", none)):
        d = str(tmp_path / name)
        table.write.parquet(f"{d}/documents.parquet")
        labels.write.parquet(f"{d}/labels.parquet")
        got = corpus_pipeline.run(spark, d)
        assert got.count() > 0 if name == "odd" else got.count() == 0
