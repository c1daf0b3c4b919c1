import math

import numpy as np
import pytest
from graphs import graph, undirected
from tripleloom.functions import features, fits
from tripleloom.operators import measures as m
from tripleloom.operators import motifs, paths, signature


def row(df):
    return df.first().asDict()


@pytest.mark.parametrize(
    "triples, want",
    [
        ([], (0, 0, 0.0, 0.0)),
        ([("s", "p", "o")], (2, 1, 0.5, 0.0)),
        ([("s", "label", '"hello"')], (1, 1, 1.0, 0.0)),
        ([("s", "label", '"hello"'), ("s", "age", '"42"')], (1, 2, 2.0, 0.0)),
        ([("a", "p", "b"), ("b", "q", "c")], (3, 2, 2 / 3, 0.0)),
        ([("s", "type", "Person"), ("s", "name", '"n"')], (2, 2, 1.0, 0.5)),
        ([("a", "p", "b")] * 3, (2, 1, 0.5, 0.0)),
    ],
)
def test_size_block(spark, triples, want):
    got = row(m.size_vocabulary(graph(spark, *triples)))
    assert tuple(got.values()) == pytest.approx(want)


def test_equal_names_are_one_vertex(spark):
    g = graph(spark, ("a", "p", '"5"'), ("b", "p", "5"))
    assert {(r.name, r.is_literal) for r in g.names.collect()} == {("a", False), ("b", False), ("5", False)}


def test_degrees_leave_out_types_and_classes(spark):
    g = graph(spark, ("a", "p", "b"), ("a", "p", "c"), *((x, "type", "C") for x in "abc"))
    out, into = row(m.degree_stats(g, "dout")), row(m.degree_stats(g, "din"))
    assert (out["max_degree"], into["max_degree"], out["n_entities"]) == (2, 1, 3)
    assert out["active_frac"] == pytest.approx(1 / 3) and into["active_frac"] == pytest.approx(2 / 3)


def test_reciprocity(spark):
    g = graph(spark, ("a", "p", "b"), ("b", "p", "a"), ("c", "p", "d"))
    assert row(m.reciprocity(g))["reciprocity"] == pytest.approx(2 / 3)
    assert row(m.symmetric_value(g))["recip_symmetric_value"] == pytest.approx(2 / 3)
    none = graph(spark, ("a", "p", "b"), ("c", "p", "d"))
    assert row(m.symmetric_value(none))["recip_symmetric_value"] is None
    assert [r.frac_symmetric for r in m.reciprocity_bins(none).collect()] == [0.0]


def test_cooccurrence_density(spark):
    d = lambda *t: {r.side: r.density for r in m.cooccurrence_density(graph(spark, *t)).collect()}
    assert d(("a", "p", "x"), ("a", "q", "y"))["subj"] == 1.0
    assert d(("a", "p", "x"), ("b", "q", "y"))["subj"] == 0.5


def test_sets(spark):
    g = graph(spark, ("a", "p", "x"), ("b", "p", "y"), ("b", "q", "z"))
    assert {(r.cs, r.n) for r in m.set_frequencies(g).collect()} == {("p", 1), ("p q", 1)}
    hub = graph(spark, *((f"s{i}", "p", "hub") for i in range(3)))
    assert (m.set_frequencies(hub).count(), m.set_frequencies(hub, True).count()) == (1, 1)
    two = graph(spark, ("s", "p1", "mid"), ("mid", "p2", "o"))
    assert [tuple(r) for r in m.two_step_pairs(two).collect()] == [("p1", "p2", 1)]
    lit = graph(spark, ("s", "p", '"x"'), ("s", "q", "o"))
    assert {r.cs for r in m.set_frequencies(lit, True).collect()} == {"q"}


def test_pair_ratios(spark):
    g = graph(spark, ("a", "p", "b"), ("a", "q", "b"), ("b", "p", "a"), ("a", "p", "a"), ("a", "p", '"l"'))
    got = row(m.pair_ratios(g))
    assert (got["edge_multiplicity"], got["bidirectional_ratio"]) == (1.5, 2.0)
    assert row(m.pair_ratios(graph(spark)))["edge_multiplicity"] is None


def test_connectivity(spark):
    cycle = graph(spark, ("a", "p", "b"), ("b", "p", "c"), ("c", "p", "a"))
    assert row(paths.largest_fraction(cycle)) == {"num_components": 1, "largest_component_fraction": 1.0}
    assert row(paths.clustering(cycle))["clustering_coefficient"] == 1.0
    s = row(paths.path_stats(cycle, 3, seed=1))
    assert (s["shortest_path_mean"], s["shortest_path_var"]) == (1.0, 0.0)
    apart = graph(spark, ("a", "p", "b"), ("c", "p", "d"), ("d", "p", "e"))
    assert row(paths.largest_fraction(apart)) == {"num_components": 2, "largest_component_fraction": 0.6}
    literal = graph(spark, ("a", "p", "b"), ("b", "label", '"hello"'))
    assert row(paths.largest_fraction(literal))["largest_component_fraction"] == 1.0
    star = graph(spark, *(("hub", "p", f"l{i}") for i in range(4)))
    assert row(paths.assortativity(star))["degree_assortativity"] < 0
    loop = graph(spark, ("a", "p", "a"), ("b", "p", "c"))
    assert row(paths.largest_fraction(loop))["num_components"] == 2


@pytest.mark.parametrize("seed", range(3))
def test_distances_and_bridges(spark, seed):
    from graphs import adjacency, random_edges

    edges = random_edges(14, 0.16, seed)
    near = adjacency(edges)
    g = undirected(spark, edges)
    src = f"v{min(near):03d}"
    got = {r.name: r.dist for r in paths.distances(g, spark.createDataFrame([(src,)], "src string")).collect()}
    want, ring, d = {min(near): 0}, [min(near)], 0
    while ring:
        d += 1
        ring = [w for w in {x for v in ring for x in near[v]} if w not in want]
        want |= dict.fromkeys(ring, d)
    assert got == {f"v{v:03d}": d for v, d in want.items()}

    def parts(es):
        root = {v: v for v in near}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in es:
            root[find(a)] = find(b)
        return len({find(v) for v in near})

    pairs = {(int(r.src[1:]), int(r.dst[1:])): r.dist for r in paths.sampled_distances(g, 100, seed).collect()}
    for (a, b), dist in pairs.items():
        ring, reached, steps = {a}, {a}, 0
        while b not in reached:
            ring = {x for v in ring for x in near[v]} - reached
            reached, steps = reached | ring, steps + 1
        assert dist == steps
    assert pairs
    cut = {e for e in edges if parts([x for x in edges if x != e]) > parts(edges)}
    assert {(int(r.u[1:]), int(r.v[1:])) for r in paths.bridges(g).collect()} == cut
    comp = {r.name: r.component for r in paths.components(g).collect()}
    assert len(set(comp.values())) == parts(edges)


def test_long_path_is_one_component(spark):
    g = undirected(spark, [(i, i + 1) for i in range(300)])
    assert {r.component for r in paths.components(g).collect()} == {"v000"}


def test_quantiles_and_decay(spark):
    x = spark.createDataFrame([(float(v),) for v in range(20)], "v double")
    got = row(x.agg(*fits.quantiles(x.v)))
    assert list(got.values()) == pytest.approx(np.quantile(np.arange(20), fits.LEVELS))
    assert row(x.limit(9).agg(*fits.quantiles(x.v)))["q50"] is None
    pinned = row(x.agg(*fits.quantiles(x.v, ends=(5.0, 3.0))))
    assert pinned["q00"] == 5.0 and pinned["q10"] == 5.0 and pinned["q100"] == pinned["q90"]
    k = np.arange(12)
    curve = spark.createDataFrame([(float(v),) for v in 10 * np.exp(-0.4 * k)], "v double")
    got = row(fits.rank_decay(curve, "v"))
    assert (got["rate"], got["scale"]) == pytest.approx((0.4, 10.0))
    assert row(fits.rank_decay(curve.limit(2), "v"))["rate"] is None


def test_power_law_maximises_the_likelihood():
    rng = np.random.default_rng(0)
    for lo, hi, alpha in ((1, 50, 1.7), (3, 400, 2.4), (1, 300_000, 2.0)):
        k = np.arange(lo, hi + 1, dtype=float)
        x = rng.choice(k, 5000, p=k**-alpha / (k**-alpha).sum())
        got = fits.power_alpha(len(x), float(np.log(x).sum()), lo, int(x.max()) if x.max() > lo else hi)
        grid = np.linspace(1.001, 2.999, 400)
        top = int(x.max())
        like = [-a * np.log(x).sum() - len(x) * np.log((np.arange(lo, top + 1, dtype=float) ** -a).sum()) for a in grid]
        assert got == pytest.approx(grid[int(np.argmax(like))], abs=0.006)
    assert math.isnan(fits.power_alpha(9, 3.0, 1, 10)) and math.isnan(fits.power_alpha(20, 0.0, 1, 1))
    exact, tail = fits.power_sums(1.5, 1, 150_000), (np.arange(1, 150_001, dtype=float) ** -1.5).sum()
    assert exact[0] == pytest.approx(tail, rel=1e-10)
    for alpha in (1 + 1e-9, 1 + 1e-6, 1.00005, 1.001, 1.2):  # near 1 the closed form cancels
        k = np.arange(25, 943_447, dtype=float)
        assert fits.power_sums(alpha, 25, 943_446) == pytest.approx(((k**-alpha).sum(), (np.log(k) * k**-alpha).sum()), rel=1e-9)


def test_feature_contract():
    assert len(features.ORDER) == len(set(features.ORDER)) == 135
    assert {b: len(n) for b, n in features.BLOCKS.items()} == {"a": 4, "b": 42, "c": 30, "d": 25, "e": 27, "f": 7}
    assert len(features.surface()) == 62
    assert features.BY_NAME["rel_freq_logq_q50"].hi == 0.0 and features.BY_NAME["num_entities"].nearest(0.2) == 1.0
    assert math.isnan(features.BY_NAME["num_entities"].nearest(math.nan))
    # every declared feature is read: a generator without it would fail or make something else
    import inspect

    from tripleloom.generator import rewire, schema, wiring

    text = "".join(map(inspect.getsource, (schema, wiring, rewire)))
    assert all(f in text or f.rstrip("0123456789").rstrip("q_") in text or f.removeprefix("inv_") in text or any(f"{{{x}}}" in text for x in ("p", "side", "prefix")) for f in features.surface())
    assert features.size_free(["num_entities", "mean_degree", "shortest_path_max"]) == ["mean_degree", "shortest_path_max"]
    assert features.size_free(["num_entities", "shortest_path_max"], weak=True) == []
    with pytest.raises(ValueError):
        features.validate(["nothing"])
    with pytest.raises(ValueError):
        features.validate(["two_step_alpha"])
    with pytest.raises(ValueError):
        features.validate(["obj_mult_alpha_q50"])
    assert len(features.validate(["type_rel_spectrum_scale", "num_entities", "mean_degree"])) == 2


def test_signature_round_trip_and_missing(spark):
    g = graph(spark, *((f"s{i}", f"p{i % 3}", f"o{i % 5}") for i in range(12)), *((f"s{i}", "type", f"C{i % 2}") for i in range(6)))
    sig = signature.measure(g, e={"largest": 7, "samples": 200, "colourings": 2}, f={"pairs": 10})
    assert list(sig) == features.ORDER and not math.isnan(sig["num_entities"]) and sig["num_classes"] == 2
    assert math.isnan(sig["cs_freq_alpha"])
    again = signature.Signature.from_json(sig.to_json())
    assert all(a == b or math.isnan(a) and math.isnan(b) for a, b in zip(sig.vector(), again.vector(), strict=True))
    with pytest.raises(ValueError):
        signature.measure(g, ["z"])
    part = signature.measure(g, ["a"])
    assert not math.isnan(part["mean_degree"]) and math.isnan(part["num_components"])


def test_partitions_and_order_do_not_matter(spark):
    rows = [(f"s{i % 9}", f"p{i % 4}", f"o{i % 7}") for i in range(40)]
    a, b = graph(spark, *rows), graph(spark, *rows[::-1])
    b.edges = b.edges.repartition(7)
    for f in (m.relation_usage, m.two_step_pairs, motifs.motifs4, m.pair_ratios, paths.assortativity):
        rows_of = lambda g, f=f: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in f(g).collect())
        assert rows_of(a) == rows_of(b)


def test_singular_values_by_subspace(spark):
    rng = np.random.default_rng(1)
    a = rng.random((7, 5))
    df = spark.createDataFrame([(i, j, float(x)) for (i, j), x in np.ndenumerate(a)], "i int, j int, x double")
    assert m.subspace_iteration(df, 3) == pytest.approx(np.linalg.svd(a, compute_uv=False)[:3], rel=1e-6)


def test_distances_beyond_sixty_four(spark):
    g = undirected(spark, [(i, i + 1) for i in range(70)])
    got = {r.name: r.dist for r in paths.distances(g, spark.createDataFrame([("v000",)], "src string")).collect()}
    assert got == {f"v{i:03d}": i for i in range(71)}


def test_drawn_pairs_are_searched_by_number(spark, monkeypatch):
    """Components of drawn pairs are made from numbers; of equally large ones the first by name counts."""
    kinds, made = [], paths.connected_components
    monkeypatch.setattr(paths, "connected_components", lambda e: kinds.extend(t for _, t in e.dtypes) or made(e))
    # the second component's vertices have the lower degrees, so the lower numbers; loops and lone vertices stay out
    apart = graph(spark, *(("a", "p", x) for x in "bcd"), ("w", "p", "x"), ("x", "p", "y"), ("y", "p", "z"), ("0", "p", "0"))
    pairs = paths.sampled_distances(apart, 50, 3).collect()
    assert kinds == ["bigint", "bigint"]
    assert pairs and {r.src for r in pairs} | {r.dst for r in pairs} <= set("abcd")
    assert all(r.dist == (1 if "a" in (r.src, r.dst) else 2) for r in pairs)
    assert paths.sampled_distances(graph(spark, ("a", "p", "a")), 5).collect() == []
