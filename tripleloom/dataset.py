"""Batches of perturbed graphs: configuration, plan, run, resume.

A run writes ``graph_<n>/`` folders with the triples and ``meta.json``, which is
written last: a unit whose ``meta.json`` is there is done.  ``manifest.jsonl``
has a row for each unit that ended, failures included.
"""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .functions import features
from .operators import compare, signature, transform

DESIGNS = ("joint", "ofat")


@dataclass(frozen=True)
class Config:
    base: str
    out_dir: Path
    design: str = "joint"
    specs: dict[str, transform.Spec] = field(default_factory=dict)
    num_graphs: int = 1
    seed: int = 0
    measure: bool = False
    generator: dict = field(default_factory=dict)
    warnings: tuple[str, ...] = ()

    @classmethod
    def parse(cls, x: dict) -> Config:
        """Check everything before anything runs."""
        if unknown := set(x) - {"base", "out_dir", "design", "features", "num_graphs", "seed", "measure", "generator"}:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        for k in ("base", "out_dir", "features"):
            if not x.get(k):
                raise ValueError(f"{k} is missing")
        design = x.get("design", "joint")
        if design not in DESIGNS:
            raise ValueError(f"unknown design: {design}")
        specs = {}
        for name, s in x["features"].items():
            s = dict(s or {})
            for k in ("levels", "clamp"):
                if k in s:
                    s[k] = tuple(s[k])
            try:
                specs[name] = transform.Spec(**s)
            except TypeError as e:
                raise ValueError(f"{name}: {e}") from None
        said = tuple(features.validate(list(specs)))
        if design == "ofat" and (bare := [n for n, s in specs.items() if not s.levels]):
            raise ValueError(f"a one-at-a-time design needs levels: {bare}")
        n = int(x.get("num_graphs", 1))
        if n < 1:
            raise ValueError("num_graphs is below 1")
        return cls(str(x["base"]), Path(x["out_dir"]), design, specs, n, int(x.get("seed", 0)), bool(x.get("measure", False)), dict(x.get("generator") or {}), said)

    @classmethod
    def from_yaml(cls, path: str, out_dir: str | None = None) -> Config:
        import yaml

        x = yaml.safe_load(Path(path).read_text())
        if out_dir:
            x["out_dir"] = out_dir
        return cls.parse(x)


def unit_seed(seed: int, index: int, use: str) -> int:
    """A unit's seeds depend on its place in the plan alone."""
    return int.from_bytes(hashlib.sha256(f"{seed}:{index}:{use}".encode()).digest()[:4], "big")


def plan(spark: SparkSession, config: Config) -> list[dict]:
    """The units in order: index, label, name and level (one-at-a-time), seeds, folder."""
    if config.design == "joint":
        rows = [{"label": "joint", "name": None, "level": None} for _ in range(config.num_graphs)]
    else:
        rows = [{"label": r.label, "name": r.name_, "level": r.level} for r in transform.ofat_plan(spark, config.specs).withColumnRenamed("name", "name_").orderBy("unit").collect()]
    width = max(4, len(str(len(rows) - 1)))
    return [r | {"index": i, "out": str(config.out_dir / f"graph_{i:0{width}d}"), "perturb_seed": unit_seed(config.seed, i, "perturb"), "generate_seed": unit_seed(config.seed, i, "generate")} for i, r in enumerate(rows)]


def pending(units: list[dict], force: bool = False) -> list[dict]:
    return [u for u in units if force or not (Path(u["out"]) / "meta.json").exists()]


def describe(spark: SparkSession, config: Config) -> str:
    units = plan(spark, config)
    head = f"{config.base}: {len(units)} graphs, {config.design}, to {config.out_dir}"
    return "\n".join([head, *config.warnings, *(f"  {u['index']:4d} {u['label']}" for u in units)])


def unit_features(spark: SparkSession, config: Config, base: dict[str, float], unit: dict) -> tuple[dict[str, float], dict]:
    """The unit's target and its clamp report."""
    table = signature.Signature(base).table(spark, "g").select("graph", "feature", "value")
    if unit["label"] == "baseline":
        return dict(base), {}
    if config.design == "joint":
        moved = transform.perturb(table, config.specs, 1, unit["perturb_seed"])
    else:
        amounts = transform.moves(spark, {unit["name"]: config.specs[unit["name"]]}).selectExpr("'g' as graph", "feature", f"cast({unit['level']} as double) as amount", "multiplicative", "clo", "chi")
        moved = transform.move(table, amounts)
    rows = moved.collect()
    report = {r.grp: {"members": r.members, "absorbed": r.absorbed, "saturated": r.saturated} for r in transform.clamp_report(moved, ["graph"]).collect()}
    return {r.feature: math.nan if r.value is None else r.value for r in rows}, report


def run_unit(spark: SparkSession, config: Config, base: dict[str, float], unit: dict) -> dict:
    """Make one graph; never raises, the row says what went wrong."""
    from .generator.rewire import generate
    from .sources import rdf

    row = {"index": unit["index"], "label": unit["label"], "out": unit["out"], "ok": False, "error": None}
    try:
        target, report = unit_features(spark, config, base, unit)
        bad = [r.reason for r in transform.realisable(signature.Signature(target).table(spark, "g").select("graph", "feature", "value")).collect()]
        if bad:
            raise ValueError(f"no graph has this signature: {bad}")
        g = generate(spark, target, unit["generate_seed"], **config.generator)
        rdf.save(g.edges, str(Path(unit["out"]) / "graph.nt"), "nt", mode="overwrite")
        meta = {**unit, "clamps": report, "features": {k: None if math.isnan(v) else v for k, v in target.items()}}
        if config.measure:
            got = signature.measure(g)
            e = compare.relative_errors(signature.Signature(target).table(spark), got.table(spark))
            meta["errors"] = compare.summary(e).first().asDict()
        Path(unit["out"]).mkdir(parents=True, exist_ok=True)
        (Path(unit["out"]) / "meta.json").write_text(json.dumps(meta, indent=1))
        row["ok"] = True
    except Exception as e:  # a failed unit is a row of the manifest
        row["error"] = f"{type(e).__name__}: {e}"[:500]
    return row


def run(spark: SparkSession, config: Config, base: dict[str, float], force: bool = False) -> list[dict]:
    """Run what is not done yet.  Each unit's work is itself distributed, so units follow one another."""
    config.out_dir.mkdir(parents=True, exist_ok=True)
    rows = []
    for unit in pending(plan(spark, config), force):
        rows.append(run_unit(spark, config, base, unit))
        with (config.out_dir / "manifest.jsonl").open("a") as f:
            f.write(json.dumps(rows[-1]) + "\n")
    return rows


def manifest(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.schema("index int, label string, out string, ok boolean, error string").json(f"{out_dir}/manifest.jsonl")
