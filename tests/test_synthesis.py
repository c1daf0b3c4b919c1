import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tripleloom import catalogue_synthesis, cli, dataset
from tripleloom.functions import features
from tripleloom.generator import allocation, rewire, schema, wiring
from tripleloom.operators import analytics, compare, measures, ranks, signature, transform


def target():
    return {f: catalogue_synthesis.TARGET.get(f, math.nan) for f in features.ORDER}


def test_schema_needs_a_whole_target():
    bad = target() | {"mean_degree": math.nan}
    with pytest.raises(ValueError, match="mean_degree"):
        schema.sample_schema(bad)
    s = schema.sample_schema(target(), 3)
    assert s.weights.sum() == pytest.approx(1) and s.class_probs.sum(1) == pytest.approx(np.ones(3))
    assert (schema.sample_schema(target(), 3).weights == s.weights).all()


def test_degree_sequence_has_the_exact_sum(spark):
    for active, mean in ((1.0, 3.0), (0.6, 2.0), (0.9, 6.0)):
        d = [r.d for r in schema.degree_sequence(spark, 500, 2.1, 7, 40, mean, active, seed=2).collect()]
        assert sum(d) == round(500 * mean) and max(d) == 40 and min(d) >= 0 and len(d) == 500


def test_largest_remainder(spark):
    x = spark.createDataFrame([(i, i % 3, float(1 + i % 5)) for i in range(30)], "k int, g int, w double")
    got = schema.largest_remainder(x, "w", 17, ["g"], "k").collect()
    for g in range(3):
        mine = [r for r in got if r.g == g]
        total = sum(r.w for r in mine)
        assert sum(r.quota for r in mine) == 17 and all(abs(r.quota - 17 * r.w / total) < 1 for r in mine)


def test_ipf_agrees_with_arrays(spark):
    rng = np.random.default_rng(0)
    row, col = np.divmod(np.arange(20), 4)
    x, rt, ct = rng.random(20) + 0.1, np.array([4.0, 5, 6, 7, 8]), np.array([6.0, 7, 8, 9])
    a = x.copy()
    for _ in range(8):
        for at, goal in ((col, ct), (row, rt)):
            a *= (goal / np.bincount(at, a))[at]
    df = spark.createDataFrame([(int(r), int(c), float(v)) for r, c, v in zip(row, col, x, strict=True)], "row int, col int, w double")
    for small in (0, 100):
        got = {(r.row, r.col): r.x for r in allocation.ipf(df, spark.createDataFrame([(i, v) for i, v in enumerate(rt.tolist())], "row int, rt double"), spark.createDataFrame([(i, v) for i, v in enumerate(ct.tolist())], "col int, ct double"), 8, small).collect()}
        assert [got[k] for k in zip(row.tolist(), col.tolist(), strict=True)] == pytest.approx(a)


def test_stubs_meet_budget_sets_and_caps(spark):
    rng = np.random.default_rng(3)
    sets = [(i, sorted(rng.choice(5, int(rng.integers(1, 4)), replace=False).tolist())) for i in range(60)]
    members = np.bincount([r for _, cs in sets for r in cs], minlength=5)
    budget = [(r, int(members[r] * 3)) for r in range(5)]
    table = lambda rows, kind: spark.createDataFrame(rows, kind)
    x, deg = table(sets, "i long, cs array<int>"), table([(i, int(rng.integers(1, 30))) for i in range(60)], "i long, d long")
    got = wiring.stubs(x, deg, table(budget, "r int, e long"), table([(r, 7) for r in range(5)], "r int, cap long")).collect()
    assert sorted((r.i, r.r) for r in got) == sorted((i, r) for i, cs in sets for r in cs)
    assert all(1 <= r.n <= 7 for r in got)
    assert np.bincount([r.r for r in got], [r.n for r in got]).tolist() == [e for _, e in budget]
    d = {r.i: r.d for r in deg.collect()}
    total = np.bincount([r.i for r in got], [r.n for r in got], 60)
    assert np.corrcoef(total, [d[i] for i in range(60)])[0, 1] > 0.4  # the table follows both margins


def test_degrees_go_to_entities_by_size_of_set(spark):
    sets = spark.createDataFrame([(i, list(range(i % 7 + 1))) for i in range(50)], "i long, cs array<int>").repartition(5)
    got = {r.i: r.d for r in wiring.match_degrees(sets, spark.createDataFrame([(i, (i * 13) % 50) for i in range(50)], "i long, d long")).collect()}
    by_size = sorted(range(50), key=lambda i: (-(i % 7 + 1), i))
    assert [got[i] for i in by_size] == sorted(got.values(), reverse=True)


def test_trimming_keeps_sets_and_bridges(spark):
    rng = np.random.default_rng(5)
    rows = sorted({(int(a), int(r), int(b)) for a, r, b in zip(rng.integers(0, 20, 200), rng.integers(0, 3, 200), rng.integers(0, 20, 200), strict=True)})
    edges, keep = spark.createDataFrame(rows, "s long, r int, o long"), spark.createDataFrame(rows[:5], "s long, r int, o long")
    left = {tuple(x) for x in wiring.trim(edges, keep, 30, 1).collect()}
    assert len(left) == len(rows) - 30 and left <= set(rows) and set(rows[:5]) <= left
    for end in (0, 2):
        assert {(x[end], x[1]) for x in left} == {(x[end], x[1]) for x in rows}


def test_ranks_span_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g) if g < 4 else None, float(v), i) for i, (g, v) in enumerate(zip(rng.integers(0, 5, 400), rng.integers(0, 50, 400), strict=True))]
    df = spark.createDataFrame(rows, "g int, v double, i int").repartition(7)
    got = ranks.numbered(df, [F.desc("v"), "i"], ["g"], F.col("v")).collect()
    assert len(got) == 400
    for g in {r[0] for r in rows}:
        mine = sorted(((v, i) for h, v, i in rows if h == g), key=lambda x: (-x[0], x[1]))
        assert [(r.v, r.i) for r in sorted((r for r in got if r.g == g), key=lambda r: r["rank"])] == mine
        before = np.cumsum([0, *(v for v, _ in mine[:-1])])
        assert [r.before for r in sorted((r for r in got if r.g == g), key=lambda r: r["rank"])] == before.tolist()


def test_distance_report_covers_every_feature_once(spark):
    a = {f: 2.0 + i % 3 for i, f in enumerate(features.ORDER)}
    a |= {f: float(k) for names in features.QUANTILES.values() for k, f in enumerate(names)} | {f"{s}_row_entropy_{q}": float(k) for s in ("subj", "obj") for k, q in enumerate(("q00", "q10", "q25", "q50", "q75", "q90", "q100"))}
    a |= {"out_degree_xmin": 1.0, "out_degree_max": 50.0, "out_degree_alpha": 2.2}
    b = a | {"mean_degree": 4.0, "cs_size_q100": 9.0, "out_degree_alpha": math.nan}
    got = compare.report(spark, a, b).collect()
    named = {r.name: r for r in got}
    assert named["cs_size"].kind == "w1_iqr" and named["cs_size"].error > 0 and named["inv_cs_size"].error == 0
    assert "cs_size_q50" not in named and named["mean_degree"].kind == "scalar" and named["out_degree_max"].kind == "scalar"
    covered = {f for *_, names in compare.distributions(a) for f in names} & {f for *_, names in compare.distributions(b) for f in names}
    assert len(got) == len(compare.distributions(b)) + len(features.ORDER) - len(covered)


def test_pairing_keeps_ends_and_makes_mutual_pairs():
    out, into = np.repeat(np.arange(20), 3), np.repeat(np.arange(10, 30), 3)
    pairs = wiring.pair_stubs(out, into, 0.0, 1)
    assert len(set(pairs)) == len(pairs) >= 57 and all(a != b for a, b in pairs)
    assert (np.bincount([a for a, _ in pairs], minlength=20) <= 3).all()
    both = wiring.pair_stubs(np.repeat(np.arange(20), 3), np.repeat(np.arange(20), 3), 0.9, 1)
    assert np.mean([(b, a) in set(both) for a, b in both]) > 0.5


def test_generated_graph_follows_its_target(spark):
    g = rewire.generate(spark, target(), seed=5, budget=100)
    again = rewire.generate(spark, target(), seed=5, budget=100)
    rows = sorted(map(tuple, g.edges.collect()))
    assert rows == sorted(map(tuple, again.edges.collect()))
    sig = signature.measure(g, ["a", "d"])
    assert sig["num_entities"] == pytest.approx(300, rel=0.15) and len(rows) == pytest.approx(1200, rel=0.15)
    assert sig["type_edge_frac"] == pytest.approx(0.1, abs=0.03)
    assert measures.class_sizes(g).count() <= 3


def test_bridges_leave_the_wanted_components(spark):
    sizes = spark.createDataFrame([(0, 90), (1, 4), (2, 3), (3, 2), (4, 1)], "component long, size long")
    plan = {r.component: r.action for r in wiring.connect_plan(sizes, 100, 3, 0.97).collect()}
    assert plan == {0: "largest", 4: "apart", 3: "apart", 2: "bridge", 1: "bridge"}


def test_perturbing_moves_groups_together(spark):
    table = catalogue_synthesis.corpus(spark, "/root/testdata/sf0.001")
    specs = {"cs_size_q50": transform.Spec(sigma=0.2), "mean_degree": transform.Spec("normal", 0.1)}
    rows = transform.perturb(table, specs, 2, seed=3).collect()
    base = {(r.graph, r.feature): r.value for r in table.collect()}
    for graph, copy in {(r.graph, r.copy) for r in rows}:
        ratio = {round(r.value / base[r.graph, r.feature], 9) for r in rows if (r.graph, r.copy) == (graph, copy) and r.feature.startswith("cs_size")}
        assert len(ratio) == 1
    still = [r for r in rows if not r.moved]
    assert still and all(r.value == base[r.graph, r.feature] for r in still)
    with pytest.raises(ValueError):
        transform.Spec("normal", 0.0)
    with pytest.raises(ValueError):
        transform.Spec("uniform")


def test_clamping_is_reported(spark):
    t = spark.createDataFrame([("g", "obj_mult_alpha_q75", 2.9), ("g", "obj_mult_alpha_q90", 3.0), ("g", "num_entities", 10.0), ("g", "mean_degree", None)], "graph string, feature string, value double")
    specs = {"obj_mult_alpha_q75": transform.Spec(levels=(1.5,)), "num_entities": transform.Spec(levels=(0.33,)), "mean_degree": transform.Spec(levels=(2.0,))}
    x = transform.perturb_levels(t, specs)
    got = {(r.unit, r.feature): r.value for r in x.collect()}
    assert got[1, "obj_mult_alpha_q75"] == got[1, "obj_mult_alpha_q90"] == 3.0 and got[2, "num_entities"] == 3.0 and got[3, "mean_degree"] is None
    rep = {(r.unit, r.grp): r.saturated for r in transform.clamp_report(x, ["unit"]).collect()}
    assert rep[1, "obj_mult_alpha_q00"] and not rep[2, "num_entities"]


def test_impossible_vectors_are_named(spark):
    good = {**target(), "num_components": 3.0}
    rows = [("good", f, v) for f, v in good.items()] + [("bad", f, v) for f, v in (good | {"num_components": 900.0, "triangle_count": -1.0, "cs_size_q10": 9.0, "cs_size_q25": 2.0}).items()]
    t = spark.createDataFrame([(g, f, None if math.isnan(v) else float(v)) for g, f, v in rows], "graph string, feature string, value double")
    got = {(r.graph, r.reason) for r in transform.realisable(t).collect()}
    assert got == {("bad", "num_components"), ("bad", "triangle_count"), ("bad", "cs_size")}


def test_distances(spark):
    f = spark.createDataFrame([("a", *map(float, range(7))), ("b", 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, None)], "name string, q00 double, q10 double, q25 double, q50 double, q75 double, q90 double, q100 double")
    moved = f.selectExpr("name", *(f"{c} + 1.5 as {c}" for c in f.columns[1:]))
    got = {r.name: r.w1 for r in compare.normalised_wasserstein(f, moved, "quantile").collect()}
    assert got == {"a": pytest.approx(1.5)}
    assert compare.normalised_wasserstein(f, f, "quantile").first().w1 == 0
    p = spark.createDataFrame([("x", 1.0, 1.0, 100.0), ("y", 2.5, 1.0, 50.0)], "name string, alpha double, lo double, hi double")
    s = {n: [r.x for r in compare.sample_fit(p, "trunc_powerlaw").filter(f"name = '{n}'").collect()] for n in "xy"}
    assert all(1 <= v <= 100 for v in s["x"]) and np.median(s["x"]) == pytest.approx(10, rel=0.15) and max(s["y"]) <= 50
    with pytest.raises(ValueError):
        compare.sample_fit(p, "other")
    t = spark.createDataFrame([("a", 2.0), ("b", float("nan"))], "feature string, value double")
    e = {r.feature: r.relative_error for r in compare.relative_errors(t, spark.createDataFrame([("a", 3.0), ("c", 1.0)], "feature string, value double")).collect()}
    assert e == {"a": 0.5, "b": None, "c": None}


def test_principal_components(spark):
    rng = np.random.default_rng(2)
    a = rng.standard_normal((40, 4)) @ rng.standard_normal((4, 4))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(a)], "k int, v array<double>")
    got = np.array([[r.pc1, r.pc2] for r in analytics.principal_components(df, "v", "k").orderBy("k").collect()])
    z = (a - a.mean(0)) / a.std(0)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    assert np.abs(got) == pytest.approx(np.abs(u[:, :2] * s[:2]), rel=1e-6)


def config(tmp_path, **more):
    return {"base": "b", "out_dir": str(tmp_path / "out"), "features": {"mean_degree": {"sigma": 0.05, "levels": [0.9, 1.1]}, "cs_size_q50": {"levels": [1.1]}, "cs_size_q90": {"levels": [1.2]}}, "generator": {"budget": 0}, **more}


def test_dataset_plan_and_checks(spark, tmp_path):
    c = dataset.Config.parse(config(tmp_path, design="ofat", seed=4))
    units = dataset.plan(spark, c)
    assert [u["label"] for u in units] == ["baseline", "mean_degree*0.9", "mean_degree*1.1", "cs_size_q50*1.1"]
    assert units[1]["perturb_seed"] == dataset.plan(spark, c)[1]["perturb_seed"] != units[2]["perturb_seed"]
    for bad in ({"design": "x"}, {"features": {"nope": {}}}, {"features": {"mean_degree": {"spread": 1}}}, {"num_graphs": 0}, {"more": 1}, {"base": ""}):
        with pytest.raises(ValueError):
            dataset.Config.parse(config(tmp_path) | bad)
    with pytest.raises(ValueError):
        dataset.Config.parse(config(tmp_path, design="ofat", features={"mean_degree": {}}))


def test_dataset_run_resumes_and_records_failures(spark, tmp_path):
    c = dataset.Config.parse(config(tmp_path, num_graphs=1))
    rows = dataset.run(spark, c, target())
    assert rows[0]["ok"], rows
    assert dataset.run(spark, c, target()) == []
    meta = json.loads((tmp_path / "out/graph_0000/meta.json").read_text())
    assert meta["features"]["mean_degree"] != 4.0 and "mean_degree" in meta["clamps"]
    lost = dataset.run(spark, c, target() | {"num_entities": math.nan}, force=True)
    assert not lost[0]["ok"] and "num_entities" in lost[0]["error"]
    assert dataset.manifest(spark, str(tmp_path / "out")).count() == 2


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "g.nt").write_text("".join(f"<http://s{i}> <http://p{i % 2}> <http://o{i % 3}> .\n" for i in range(6)))
    assert cli.main(["measure", str(tmp_path / "g.nt"), "--blocks", "a,d", "--out", str(tmp_path / "sig/s.json")], spark) == 0
    assert cli.main(["compare", str(tmp_path / "sig/s.json"), str(tmp_path / "g.nt"), "--blocks", "a"], spark) == 0
    assert "'mean_error': 0.0" in capsys.readouterr().out
    assert signature.read_corpus(spark, str(tmp_path / "sig/*.json")).filter("feature = 'num_relations'").first().value == 2
    (tmp_path / "t.json").write_text(signature.Signature(target()).to_json())
    assert cli.main(["generate", str(tmp_path / "t.json"), "--out", str(tmp_path / "made"), "--budget", "0"], spark) == 0
    with pytest.raises(SystemExit):
        cli.main([])


def test_a_run_without_a_budget_rewires_in_full(tmp_path, monkeypatch):
    import inspect

    assert inspect.signature(rewire.generate).parameters["budget"].default == 50_000
    given = []
    monkeypatch.setattr(rewire, "generate", lambda spark, values, seed, budget, chains: given.append(budget) or 1 / 0)
    (tmp_path / "t.json").write_text("{}")
    monkeypatch.setattr(signature.Signature, "from_json", staticmethod(lambda text: {}))
    with pytest.raises(ZeroDivisionError):
        cli.main(["generate", str(tmp_path / "t.json"), "--out", str(tmp_path / "made")], None)
    assert given == [50_000]


def test_samplers_curves_and_size_free_tables(spark, tmp_path):
    rows = [(f"g{i}", f, float(1 + i + k)) for i in range(3) for k, f in enumerate(("num_entities", "mean_degree", "two_step_vmin"))]
    pop = spark.createDataFrame(rows, "graph string, feature string, value double")
    x = transform.UniformRange(widen=0.0).draw(pop, 4, seed=1).filter("value is not null and feature <> 'num_classes'").collect()
    lim = {f: ([v for _, g, v in rows if g == f][0], [v for _, g, v in rows if g == f][-1]) for f in ("num_entities", "mean_degree", "two_step_vmin")}
    assert len(x) == 12 and all(lim[r.feature][0] <= r.value <= lim[r.feature][1] for r in x)
    transform.UniformRange().save(pop, str(tmp_path / "drawn"), 2, seed=1)
    assert spark.read.json(str(tmp_path / "drawn")).count() == 2
    assert {r.feature for r in transform.size_free(pop).collect()} == {"mean_degree", "two_step_vmin"}
    assert {r.feature for r in transform.size_free(pop, weak=True).collect()} == {"mean_degree"}
    values = {f"cs_size_{s}": float(k) for k, s in enumerate(("q00", "q10", "q25", "q50", "q75", "q90", "q100"))} | {"out_degree_alpha": 2.0, "out_degree_xmin": 1.0, "out_degree_max": 9.0, "subj_cooc_rate": 1.0, "subj_cooc_scale": 2.0}
    lines = {}
    for r in compare.curves(spark, values).collect():
        lines.setdefault(r.name, []).append((r.x, r.y))
    assert lines["cs_size"] == [(level, float(k)) for k, level in enumerate((0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0))]
    assert lines["out_degree"][0] == (1.0, 1.0) and lines["out_degree"][-1][1] == pytest.approx(0, abs=1e-9) and lines["subj_cooc"][1][1] == pytest.approx(2 / math.e)


def test_round_trip_measures_what_was_made(spark):
    from tripleloom.operators import studies

    got = studies.round_trip(spark, target(), [1], ["a"], "plain", budget=0).collect()
    assert {r.feature for r in got} == {"num_entities", "num_relations", "mean_degree", "type_edge_frac"} and all(r.config == "plain" for r in got)
    assert max(r.relative_error for r in got if r.feature in ("num_relations", "mean_degree")) < 0.35
