import json
import math

import numpy as np
import pytest
from graphs import graph
from tripleloom import catalogue_synthesis
from tripleloom.functions import fits, register
from tripleloom.operators import signature, transform
from tripleloom.sources import corpus


def test_files_of_a_corpus(spark, tmp_path):
    for name, size in (("b", 3), ("a", 9), ("c", 0)):
        (tmp_path / name).mkdir()
        if size:
            (tmp_path / name / "g.nt").write_text("".join(f"<http://s{i}> <http://p> <http://o{i}> .\n" for i in range(size)))
            (tmp_path / name / "g_synth.nt").write_text("x")
    assert corpus.graph_names(str(tmp_path)) == ["a", "b", "c"]
    assert [n for n, f in corpus.graph_files(str(tmp_path))] == ["b", "a"] and corpus.graph_file(tmp_path / "c") is None
    with pytest.raises(FileNotFoundError):
        corpus.graph_dir(str(tmp_path), "nope")
    got = corpus.measured_or_cached(spark, str(tmp_path), "b", ["a"])
    assert (got["num_entities"], got["num_relations"]) == (6, 1)
    corpus.write_signature(got, str(tmp_path / "b/signature"))
    rows = {(r.graph, r.feature): r.value for r in corpus.aggregate(spark, str(tmp_path)).collect()}
    assert rows["b", "num_entities"] == 6


def test_outputs_merge_and_rebuild(spark, tmp_path):
    g = graph(spark, ("a", "p", "b"), ("b", "q", "c"))
    out = str(tmp_path / "s")
    assert corpus.write_signature(signature.measure(g, ["a"]), out, "x") == ["block_a.json", "signature.json", "summary.txt"]
    corpus.write_signature(signature.measure(g, ["d"]), out)
    both = corpus.read_signature(out)
    assert both["num_entities"] == 3 and both["num_distinct_cs"] == 2 and math.isnan(both["num_components"])
    (tmp_path / "s/signature.json").write_text(json.dumps({"source": "", "features": {}}))
    before, after = corpus.rebuild(out, write=True)
    assert before == 135 > after and signature.Signature.from_json((tmp_path / "s/signature.json").read_text())["num_entities"] == 3


def test_yaml_targets(tmp_path):
    sig = signature.Signature({"num_entities": 5, "triangle_count": 2})
    corpus.to_yaml(sig, str(tmp_path / "t.yaml"))
    again = corpus.from_yaml(str(tmp_path / "t.yaml"))
    assert again["num_entities"] == 5 and math.isnan(again["mean_degree"])
    (tmp_path / "u.yaml").write_text("block_a: {}\n")
    with pytest.raises(KeyError, match="block_b"):
        corpus.from_yaml(str(tmp_path / "u.yaml"))


def test_sql_functions(spark):
    register.register(spark)
    rng = np.random.default_rng(0)
    k = np.arange(1, 60, dtype=float)
    x = rng.choice(k, 400, p=k**-1.8 / (k**-1.8).sum())
    df = spark.createDataFrame([(int(v % 2), int(v)) for v in x], "g int, v int")
    df.createOrReplaceTempView("counts_of")
    got = {r.g: r.a for r in spark.sql("SELECT g, powerlaw_alpha(v) AS a FROM counts_of GROUP BY g").collect()}
    for g in (0, 1):
        mine = x[x % 2 == g]
        assert got[g] == pytest.approx(fits.power_alpha(len(mine), float(np.log(mine).sum()), 1, int(mine.max())))
    df.groupBy("g").agg(*register.sufficient("v")).createOrReplaceTempView("stats_of")
    assert {r.g: r.a for r in spark.sql("SELECT g, powerlaw_alpha_of(n, sum_log, hi) AS a FROM stats_of").collect()} == pytest.approx(got)
    assert spark.sql("SELECT * FROM parse_turtle('<http://a> <http://b> 1, 2 .')").count() == 2


def test_registry_of_transforms(spark):
    t = catalogue_synthesis.corpus(spark, "/root/testdata/sf0.001")
    same = transform.TRANSFORMS["identity"](t, None, 2)
    assert same.count() == 2 * t.count() and not same.filter("moved").count()
    assert transform.TRANSFORMS["joint"](t, {"mean_degree": transform.Spec()}, 1, 3).filter("moved").count() == t.select("graph").distinct().count()


def test_tagged_values(tmp_path):
    import numpy as np

    x = {"_counts": {1: 2, "a": (1.5, None)}, "m": np.arange(4).reshape(2, 2), "n": np.int64(3), "l": [True, "s"]}
    corpus.write_tagged(x, str(tmp_path / "b.json"))
    assert corpus.read_tagged(str(tmp_path / "b.json")) == {"counts": {1: 2, "a": [1.5, None]}, "m": [[0, 1], [2, 3]], "n": 3, "l": [True, "s"]}
    assert corpus.untag({corpus.TAG: "PowerLawStats", "data": [2.0, 1.0, 9.0]}) == [2.0, 1.0, 9.0]
    with pytest.raises(ValueError):
        corpus.untag({corpus.TAG: "other"})
    with pytest.raises(TypeError):
        corpus.tag(object())


def test_run_tables(spark, tmp_path):
    from tripleloom.sources import logs

    df = spark.createDataFrame([(1, "a", 0.5), (2, "b", 1.5)], "step long, term string, error double")
    for kind in ("csv", "jsonl"):
        logs.write_table(df, str(tmp_path / f"t.{kind}"))
        got = logs.read_table(spark, str(tmp_path / f"t.{kind}")).select("step", "term", "error")
        assert sorted((int(r[0]), r[1], r[2]) for r in got.collect()) == [(1, "a", 0.5), (2, "b", 1.5)]
    with pytest.raises(ValueError):
        logs.read_table(spark, "x.xml")
