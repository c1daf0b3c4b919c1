from itertools import permutations

import pytest
from graphs import adjacency, kinds, random_edges, stars, undirected
from tripleloom.generator import rewire
from tripleloom.operators import motifs

CYCLE, DIAMOND, K4, PAW = [(0, 1), (1, 2), (2, 3), (0, 3)], [(0, 1), (1, 2), (2, 3), (0, 3), (0, 2)], [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)], [(0, 1), (1, 2), (0, 2), (2, 3)]


def four(spark, edges):
    return tuple(motifs.motifs4(undirected(spark, edges)).first())


@pytest.mark.parametrize("edges, want", [(CYCLE, (1, 0, 0, 0)), (DIAMOND, (0, 1, 0, 0)), (K4, (0, 0, 1, 0)), (PAW, (0, 0, 0, 1)), ([(0, 1), (0, 2), (0, 3)], (0,) * 4), ([(0, 1), (1, 2), (2, 3)], (0,) * 4), (CYCLE + [(a + 9, b + 9) for a, b in CYCLE], (2, 0, 0, 0))])
def test_four_vertices(spark, edges, want):
    assert four(spark, edges) == want


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    edges = random_edges(9, 0.3 + 0.1 * seed, seed)
    g, k4 = undirected(spark, edges), kinds(edges, 4)
    assert tuple(motifs.motifs4(g).first()) == tuple(k4.get(x, 0) for x in ("2,2,2,2", "2,2,3,3", "3,3,3,3", "1,2,2,3"))
    k3 = kinds(edges, 3)
    assert tuple(motifs.motifs3(g).first()) == (len(edges), k3.get("2,2,2", 0), k3.get("1,1,2", 0))
    per = {r.name: r.triangles for r in motifs.triangles_per_vertex(g).collect()}
    assert sum(per.values()) == 3 * k3.get("2,2,2", 0)
    assert {r.ds: r.n for r in motifs.graphlets(g, 5).collect()} == kinds(edges, 5)
    assert motifs.cycles(g, 6).first()[0] == kinds(edges, 6).get("2,2,2,2,2,2", 0)
    got = {r.k: r.stars for r in motifs.stars(g, 5).collect()}
    assert {k: got.get(k, 0) for k in range(2, 6)} == {k: stars(edges, k) for k in range(2, 6)}


def test_triangles_of_many_kinds(spark):
    from graphs import graph

    # kinds are names without digits; ends of every kind meet, in all orders of degree
    edges, name = random_edges(18, 0.35, 11), lambda i: f"{'abcdef'[i % 6]}/{i}"
    g = graph(spark, *((name(a), "r", name(b)) for a, b in edges), *((name(i), "type", f"class/{i % 6}") for i in range(18)))
    whole = [(name(a), name(b)) for a, b in edges] + [(name(i), f"class/{i % 6}") for i in range(18)]
    near = adjacency(whole)
    want = {frozenset((a, b, c)) for a, b in whole for c in near[a] & near[b]}
    at = {r.r: r.name for r in g.ranked.collect()}
    rows = [frozenset(at[v] for v in r) for r in motifs.triangles(g).collect()]
    assert sorted(at) == list(range(len(at))) and g.order == len(at)
    assert set(rows) == want and len(rows) == len(want)


def test_kinds_without_triangles_leave_no_wedges():
    pairs = [(1, 2), (2, 3), (1, 3), (1, 9), (3, 9), (9, 8)]
    low, long_, far = motifs.kind_legs(pairs)
    assert (low, long_, far) == ([(1, 2), (1, 3)], [(1, 3), (1, 9)], [(2, 3), (3, 9)])
    assert motifs.kind_legs([(1, 2), (2, 3), (4, 1)]) == ([], [], [])
    assert motifs.kind_legs([(5, 5)]) == ([(5, 5)],) * 3


@pytest.mark.parametrize("light", [0, 5, 7, 4000])
def test_squares_in_arrays_and_rows(spark, light):
    edges = random_edges(16, 0.4, 4) + [(20, i) for i in range(16)]
    near, g = adjacency(edges), undirected(spark, edges)
    want = sum(n * (n - 1) // 2 for n in (len(near[a] & near[b]) for a in near for b in near if a < b)) // 2
    small = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # the rows of a vertex lie in several batches
    try:
        assert motifs.squares(g, light).first()[0] == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", small)


def test_stars_read_degrees_of_the_numbering(spark):
    g = undirected(spark, [(0, 1), (0, 2), (0, 3), (4, 5), (5, 6), (4, 6), (6, 7)])
    got = {r.k: r.stars for r in motifs.stars_triangle_free(g, 3).collect()}
    assert got == {2: 3.0, 3: 1.0} and not {"degrees", "both_ways"} & set(vars(g))  # the edges are made distinct once


def test_star_estimates_of_centres_above_the_guard(spark):
    edges = random_edges(24, 0.25, 5)
    free = 3
    near = adjacency(edges)
    v = max(near, key=lambda x: len(near[x]))
    inside = [(a, b) for a, b in edges if a in near[v] and b in near[v]]
    want, got = motifs.independent_sets(inside, free, 5), motifs.estimated_sets(inside, free, 5, 4000)
    assert got == pytest.approx(want, rel=0.1)
    g = undirected(spark, edges)
    exact = {r.k: r.stars for r in motifs.stars(g, 4).collect()}
    rows = motifs.stars(g, 4, guard=2, draws=2000).collect()
    assert not all(r.exact for r in rows) and {r.k: r.stars for r in rows} == pytest.approx(exact, rel=0.1)


def test_hybrid_counter(spark):
    edges = random_edges(10, 0.4, 2)
    g = undirected(spark, edges)
    assert {r.ds: r.n for r in motifs.HybridCounter().count(g, 5).collect()} == kinds(edges, 5)
    rough = motifs.HybridCounter(max_degree=1, sampled=motifs.SampledCounter(300, 8)).count(g, 4).collect()
    assert rough and not any(r.exact for r in rough)


def test_guard(spark):
    with pytest.raises(RuntimeError):
        motifs.graphlets(undirected(spark, [(0, i) for i in range(1, 9)]), 5, max_degree=5)


def test_spanning_paths_table():
    for ds, edges in {"2,2,2": [(0, 1), (1, 2), (0, 2)], "1,1,2,2": [(0, 1), (1, 2), (2, 3)], "2,2,2,2": CYCLE, "1,2,2,3": PAW, "2,2,3,3": DIAMOND, "3,3,3,3": K4, "2,2,2,2,2": [(i, (i + 1) % 5) for i in range(5)], "2,2,2,2,2,2": [(i, (i + 1) % 6) for i in range(6)]}.items():
        near = adjacency(edges)
        assert motifs.SPANNING_PATHS[ds] == sum(all(b in near[a] for a, b in zip(p, p[1:], strict=False)) for p in permutations(near)), ds


def test_colour_coding_estimates(spark):
    edges = random_edges(16, 0.35, 7)
    g, truth = undirected(spark, edges), kinds(edges, 4)
    got = {r.ds: r.estimate for r in motifs.colour_coding(g, 4, samples=400, colourings=24).collect()}
    for ds in ("2,2,2,2", "2,2,3,3", "1,2,2,3", "1,1,2,2"):
        assert got[ds] == pytest.approx(truth[ds], rel=0.35), ds
    total = motifs.colourful_total(g, 4, 24)
    assert total.agg({"paths": "avg"}).first()[0] == pytest.approx(sum(truth[d] * n for d, n in motifs.SPANNING_PATHS.items() if d in truth), rel=0.25)


def test_star_estimates(spark):
    edges = random_edges(14, 0.3, 3)
    got = motifs.colour_coding_stars(undirected(spark, edges), 2, samples=300, colourings=24).first().estimate
    assert got == pytest.approx(stars(edges, 2), rel=0.3)


@pytest.mark.parametrize("seed", range(8))
def test_incremental_counts_equal_counting_again(seed):
    import random

    rng, edges = random.Random(seed), random_edges(9, 0.45, seed)
    state, now = rewire.State(iter(edges)), set(edges)

    def truth():
        k3, k4 = kinds(now, 3), kinds(now, 4)
        return {"triangle_count": k3.get("2,2,2", 0), "four_cycle_count": k4.get("2,2,2,2", 0), "diamond_count": k4.get("2,2,3,3", 0), "k4_count": k4.get("3,3,3,3", 0), "tailed_triangle_count": k4.get("1,2,2,3", 0)}

    assert state.counts == truth()
    for _ in range(25):
        a, b = sorted(rng.sample(range(9), 2))
        if (a, b) in now:
            state.remove(a, b)
            now.discard((a, b))
        else:
            state.add(a, b)
            now.add((a, b))
        assert state.counts == truth()


def test_annealing_lowers_the_loss_and_keeps_degrees():
    edges = [(f"s{i % 20}", f"p{i % 3}", f"o{(i * 7) % 15}") for i in range(60)]
    edges = sorted(set(edges))
    target = {"triangle_count": 0.0, "four_cycle_count": 5.0}
    kept, log = rewire.anneal(edges, target, 400, seed=1)
    count = lambda es: rewire.loss(rewire.State((s, o) for s, _, o in es).counts, target)
    assert count(kept) <= count(edges) and log
    for end in (0, 2):
        assert sorted((e[end], e[1]) for e in kept) == sorted((e[end], e[1]) for e in edges)
    assert rewire.anneal(edges, target, 400, seed=1)[0] == kept


@pytest.mark.parametrize("seed", range(6))
def test_incremental_cycles_clustering_and_mixing(seed):
    import random

    import numpy as np

    rng, now = random.Random(seed), set(random_edges(10, 0.35, seed))
    state = rewire.State(iter(sorted(now)), rewire.MORE)

    def truth():
        near = adjacency(now)
        local = [2 * sum(b in near[a] for a in near[v] for b in near[v] if a < b) / (len(near[v]) * (len(near[v]) - 1)) if len(near[v]) > 1 else 0.0 for v in near]
        return kinds(now, 5).get("2,2,2,2,2", 0), kinds(now, 6).get("2,2,2,2,2,2", 0), sum(local) / len(state.near)

    for _ in range(20):
        got = state.counts
        assert (got["five_cycle_count"], got["six_cycle_count"], got["clustering_coefficient"]) == pytest.approx(truth())
        # a swap keeps every vertex's ends
        (a, b), (c, d) = rng.sample(sorted(now), 2)
        new = [tuple(sorted(x)) for x in ((a, d), (c, b))]
        if a == d or c == b or set(new) & now or new[0] == new[1]:
            continue
        for e in ((a, b), (c, d)):
            state.remove(*e)
            now.discard(e)
        for e in new:
            state.add(*e)
            now.add(e)
        deg = {v: len(w) for v, w in adjacency(now).items()}
        x = [deg[u] for e in now for u in e]
        y = [deg[u] for e in now for u in e[::-1]]
        if np.std(x) > 0:
            assert state.counts["degree_assortativity"] == pytest.approx(np.corrcoef(x, y)[0, 1])


def test_refining_logs_swaps_and_errors(spark):
    from tripleloom.operators import studies

    edges = sorted({(f"s{i % 12}", f"p{i % 2}", f"o{(i * 5) % 11}") for i in range(50)})
    from graphs import graph

    g = rewire.refine(graph(spark, *edges), {"triangle_count": 3.0, "four_cycle_count": 4.0}, budget=60, chains=2, seed=3)
    swaps = g.swaps.collect()
    assert {r.chain for r in swaps} == {0, 1} and all(0 <= r.step < 60 and r.degree >= 1 for r in swaps)
    assert {(r.step, r.term) for r in g.convergence.collect()} == {(s, t) for s in (0, 60) for t in ("triangle_count", "four_cycle_count")}
    assert g.edges.count() == len(edges)
    by = studies.delta_profile(g.swaps).collect()
    assert sum(r.n for r in by) == len(swaps)
    assert studies.guard_effect(g.swaps, 0).first().passed_over == 1.0
    seen = []
    rewire.anneal(edges, {"triangle_count": 1.0}, 20, callback=lambda step, es: seen.append((step, len(es))), every=10)
    assert seen == [(0, len(edges)), (10, len(edges)), (20, len(edges))]
