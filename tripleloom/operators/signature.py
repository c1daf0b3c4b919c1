"""The signature of a graph: 135 numbers in six blocks."""

from __future__ import annotations

import json
import math
from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features, fits
from ..plans.graph import Graph
from . import measures as m
from . import motifs, paths


def _one(df: DataFrame) -> dict:
    r = df.first()
    return r.asDict() if r else {}


def _named(prefix: str, row: dict) -> dict:
    return {f"{prefix}_{s}": row.get(s) for s in fits.SUFFIXES}


class Block(ABC):
    """Some features of a graph.  Subclasses may be added to :data:`BLOCKS`."""

    letter: str

    @classmethod
    def feature_names(cls) -> list[str]:
        return features.BLOCKS[cls.letter]

    @classmethod
    def missing(cls) -> dict[str, float]:
        return dict.fromkeys(cls.feature_names(), math.nan)

    @abstractmethod
    def measure(self, g: Graph) -> dict[str, float | None]:
        """Values by feature name; what is absent or None becomes NaN."""

    def __call__(self, g: Graph) -> dict[str, float]:
        found = self.measure(g)
        return {f: math.nan if (v := found.get(f)) is None else float(v) for f in self.feature_names()}


class SizeBlock(Block):
    letter = "a"

    def measure(self, g: Graph) -> dict:
        return _one(m.size_vocabulary(g))


class RelationBlock(Block):
    letter = "b"

    def measure(self, g: Graph) -> dict:
        out: dict = {}
        for side, c in (("out", "dout"), ("in", "din")):
            d = _one(m.degree_stats(g, c))
            out |= {f"{side}_degree_max": d["max_degree"] or 0, f"{side}_degree_p90": d["p90"] or 0.0, ("subject" if side == "out" else "object") + "_frac": d["active_frac"] or 0.0}
        for r in m.degree_powerlaw(g).collect():
            out |= {f"{r.side}_degree_alpha": r.alpha, f"{r.side}_degree_xmin": None if r.alpha is None or math.isnan(r.alpha) else 1}
        out |= _named("rel_freq_logq", _one(m.relation_quantiles(g)))
        for r in m.multiplicity_alpha_quantiles(g).collect():
            out |= _named(f"{r.side}_mult_alpha", r.asDict())
        for side in ("obj", "subj"):
            out[f"{side}_mult_max"] = m.multiplicities(g, side).agg(F.max("m")).first()[0]
        out |= {r.side: r.slope for r in m.size_offset(g).collect()}
        out |= {f"recip_symmetric_frac_bin{r.bin}": r.frac_symmetric for r in m.reciprocity_bins(g).collect()}
        return out | _one(m.symmetric_value(g))


class SchemaBlock(Block):
    letter = "c"

    def measure(self, g: Graph) -> dict:
        spark = g.edges.sparkSession
        sizes = _one(m.class_sizes(g).agg(F.count(F.lit(1)).alias("n"), F.max("n_instances").alias("top")))
        fit = _one(m.class_size_powerlaw(g))
        alpha = fit.get("alpha")
        out = {"num_classes": sizes["n"], "class_size_max": sizes["top"], "class_size_alpha": alpha, "class_size_xmin": None if alpha is None or math.isnan(alpha) else 1}
        for side in ("subj", "obj"):
            out |= {f"{side}_cooc_{k}": v for k, v in _one(fits.rank_decay(m.cooccurrence_spectrum(g, side), "value")).items()}
        out |= {f"{r.side}_cooc_density": r.density or 0.0 for r in m.cooccurrence_density(g).collect()}
        out |= {k: v for k, v in _one(m.pair_ratios(g)).items() if k in self.feature_names()}
        for r in m.row_entropy_quantiles(g).collect():
            out |= _named(f"{r.side}_row_entropy", r.asDict())
        out |= {f"type_rel_spectrum_{k}": v for k, v in _one(fits.rank_decay(m.type_spectrum(g), "value")).items()}
        out |= {f"per_type_entropy_{k}": v for k, v in _one(m.per_type_entropy_decay(g)).items()}
        del spark
        return out


class SetBlock(Block):
    letter = "d"

    def measure(self, g: Graph) -> dict:
        out: dict = {}
        for inv, prefix in ((False, ""), (True, "inv_")):
            out[f"{prefix}num_distinct_cs"] = m.set_frequencies(g, inv).count()
            out |= _named(f"{prefix}cs_size", _one(m.set_size_quantiles(g, inv)))
            out |= _range(f"{prefix}cs_freq", _one(m.set_frequency_powerlaw(g, inv)))
        return out | _range("two_step", _one(m.two_step_powerlaw(g)))


def _range(prefix: str, fit: dict) -> dict:
    alpha = fit.get("alpha")
    if alpha is None or math.isnan(alpha):
        return {}
    return {f"{prefix}_alpha": alpha, f"{prefix}_vmin": fit["lo"], f"{prefix}_vmax": fit["hi"]}


class MotifBlock(Block):
    """Exact up to four vertices; five and six exactly under the degree guard, else by colour coding, as seven to ``largest`` always.

    Sizes above six are left out where vertices x 2**k x k x 4 bytes are more than ``memory``.
    ``estimated`` names the features that are estimates after a measurement.
    """

    letter = "e"

    def __init__(self, largest: int = 10, samples: int = 100_000, colourings: int = 16, max_degree: int = 50, seed: int = 0, memory: float = 1e9, adaptive: bool = False, counter: motifs.Counter | None = None):
        self.largest, self.memory = largest, memory
        self.counter = counter or motifs.HybridCounter(max_degree, 6, motifs.SampledCounter(samples, colourings, seed, adaptive))
        self.estimated: set[str] = set()

    def _kinds(self, g: Graph, k: int) -> dict[str, float]:
        rows = self.counter.count(g, k).collect()
        if any(not r.exact for r in rows):
            self.estimated |= {f"path_template_zipf_k{k}", f"path_template_entropy_k{k}", "tree_template_zipf", "tree_template_entropy"} | ({{5: "five", 6: "six"}[k] + "_cycle_count"} if k in (5, 6) else set())
        return {r.ds: float(r.n) for r in rows}

    def measure(self, g: Graph) -> dict:
        spark = g.edges.sparkSession
        three, four = _one(motifs.motifs3(g)), _one(motifs.motifs4(g))
        out = {"triangle_count": three["triangles"], "four_cycle_count": four["four_cycle"], "diamond_count": four["diamond"], "k4_count": four["k4"], "tailed_triangle_count": four["tailed_triangle"]}
        kinds: dict[int, dict[str, float]] = {2: {"1,1": three["edges"]}, 3: {"2,2,2": three["triangles"], "1,1,2": three["wedges"]}}
        if not three["edges"]:
            return out | {"five_cycle_count": 0, "six_cycle_count": 0}
        self.estimated = set()
        vertices = g.ranked.count()
        for k in range(4, self.largest + 1):
            if k <= 6 or vertices * 2**k * k * 4 <= self.memory:
                kinds[k] = self._kinds(g, k)
        out |= {"five_cycle_count": kinds.get(5, {}).get("2,2,2,2,2", 0 if self.largest >= 5 else None), "six_cycle_count": kinds.get(6, {}).get("2,2,2,2,2,2", 0 if self.largest >= 6 else None)}

        def stats(counts: list[float]) -> dict:
            return _one(motifs.template_stats(spark.createDataFrame([(float(c),) for c in counts if c > 0], "n double"))) if any(counts) else {}

        for k, by in kinds.items():
            s = stats(list(by.values()))
            out |= {f"path_template_zipf_k{k}": s.get("zipf"), f"path_template_entropy_k{k}": s.get("entropy")}
        s = stats([sum(by.values()) for by in kinds.values()])
        return out | {"tree_template_zipf": s.get("zipf"), "tree_template_entropy": s.get("entropy")}


class ConnectivityBlock(Block):
    letter = "f"

    def __init__(self, pairs: int = 1000, seed: int = 42, skip_paths: bool = False):
        self.pairs, self.seed, self.skip_paths = pairs, seed, skip_paths

    def measure(self, g: Graph) -> dict:
        out = _one(paths.largest_fraction(g)) | _one(paths.clustering(g)) | _one(paths.assortativity(g))
        return out if self.skip_paths else out | _one(paths.path_stats(g, self.pairs, self.seed))


BLOCKS: dict[str, type[Block]] = {b.letter: b for b in (SizeBlock, RelationBlock, SchemaBlock, SetBlock, MotifBlock, ConnectivityBlock)}


class Signature(dict):
    """Feature values by name, in order; unmeasured ones are NaN."""

    def __init__(self, values: dict[str, float] | None = None, estimated: set[str] | None = None):
        values = values or {}
        self.estimated = set(estimated or ())
        super().__init__({f: float(values.get(f, math.nan)) for f in features.ORDER})

    def vector(self) -> list[float]:
        return list(self.values())

    def table(self, spark: SparkSession, graph: str = "graph") -> DataFrame:
        return spark.createDataFrame([(graph, features.BLOCK_OF[f], f, None if math.isnan(v) else v) for f, v in self.items()], "graph string, block string, feature string, value double")

    def to_json(self, source: str = "") -> str:
        return json.dumps({"source": source, "features": {f: None if math.isnan(v) else v for f, v in self.items()}}, indent=1)

    @classmethod
    def from_json(cls, text: str) -> Signature:
        x = json.loads(text)["features"]
        return cls({f: math.nan if v is None else v for f, v in x.items()})

    def summary(self) -> str:
        return "\n".join(f"{b}: " + ", ".join(f"{f}={self[f]:.6g}" for f in names) for b, names in features.BLOCKS.items())


def measure(g: Graph, blocks: list[str] | None = None, **options: dict) -> Signature:
    """Measure the named blocks (default: all); ``options`` has arguments for a block's constructor by its letter."""
    blocks = [b.lower() for b in (blocks or list(BLOCKS))]
    if unknown := sorted(set(blocks) - set(BLOCKS)):
        raise ValueError(f"unknown blocks: {unknown}")
    g.persist()
    try:
        values: dict[str, float] = {}
        estimated: set[str] = set()
        for b in blocks:
            block = BLOCKS[b](**options.get(b, {}))
            values |= block(g)
            estimated |= getattr(block, "estimated", set())
        return Signature(values, estimated)
    finally:
        g.unpersist()


def read_corpus(spark: SparkSession, pattern: str) -> DataFrame:
    """``(graph, feature, value)`` of signature files; the graph is the folder above ``signature/``."""
    raw = spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", "features map<string,double>", {"allowNonNumericNumbers": "true"}).alias("j"))
    name = F.regexp_extract("path", r"([^/]+)/(?:signature/)?[^/]+$", 1)
    return raw.select(name.alias("graph"), F.explode("j.features").alias("feature", "value")).select("graph", "feature", F.when(~F.isnan("value"), F.col("value")).alias("value"))
