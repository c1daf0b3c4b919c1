"""Folders of graphs and signatures.

A corpus is a folder with one folder per graph, which holds the graph's file and
``signature/signature.json``; ``block_<letter>.json`` files may stand beside it.
"""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features
from ..operators.signature import Signature, read_corpus

#: Names of graph files end with one of these, or have no ending.
ENDINGS = (".nt", ".ttl", "")


def graph_names(root: str) -> list[str]:
    return sorted(p.name for p in Path(root).iterdir() if p.is_dir())


def graph_dir(root: str, name: str) -> Path:
    p = Path(root) / name
    if not p.is_dir():
        raise FileNotFoundError(f"no graph {name!r} in {root}; there are {graph_names(root)}")
    return p


def graph_file(folder: Path) -> Path | None:
    """The folder's graph file; synthetic ones (``*_synth``) don't count."""
    found = sorted(p for p in Path(folder).iterdir() if p.is_file() and p.suffix in ENDINGS and not p.stem.endswith("_synth"))
    return found[0] if found else None


def graph_files(root: str) -> list[tuple[str, Path]]:
    """``(name, file)`` of the graphs that have a file, smallest first."""
    found = [(n, f) for n in graph_names(root) if (f := graph_file(Path(root) / n))]
    return sorted(found, key=lambda x: (x[1].stat().st_size, x[0]))


def write_signature(sig: Signature, folder: str, source: str = "", merge: bool = True) -> list[str]:
    """Write ``block_<letter>.json`` for measured blocks, ``signature.json`` and ``summary.txt``; the files' names.

    With ``merge`` blocks that were written before and are not measured now stay.
    """
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    values, written = dict(sig), []
    for letter, names in features.BLOCKS.items():
        at = out / f"block_{letter}.json"
        if any(not math.isnan(values[f]) for f in names):
            at.write_text(json.dumps({f: None if math.isnan(values[f]) else values[f] for f in names}, indent=1))
            written.append(at.name)
        elif merge and at.exists():
            values |= {f: math.nan if v is None else v for f, v in json.loads(at.read_text()).items()}
    whole = Signature(values)
    (out / "signature.json").write_text(whole.to_json(source))
    (out / "summary.txt").write_text(whole.summary() + "\n")
    return [*written, "signature.json", "summary.txt"]


def read_signature(folder: str) -> Signature:
    """The blocks that are there, or else ``signature.json``."""
    values: dict[str, float] = {}
    for letter in features.BLOCKS:
        at = Path(folder) / f"block_{letter}.json"
        if at.exists():
            values |= {f: math.nan if v is None else v for f, v in json.loads(at.read_text()).items()}
    return Signature(values) if values else Signature.from_json((Path(folder) / "signature.json").read_text())


def rebuild(folder: str, write: bool = False) -> tuple[int, int]:
    """Make ``signature.json`` from the blocks again; how many values were missing before and are now."""
    at = Path(folder) / "signature.json"
    count = lambda s: sum(map(math.isnan, s.values()))
    before = Signature.from_json(at.read_text()) if at.exists() else Signature()
    after = read_signature(folder)
    if write:
        at.write_text(after.to_json())
    return count(before), count(after)


def to_yaml(sig: Signature, path: str) -> None:
    """A target file: a mapping for each of the six blocks."""
    import yaml

    Path(path).write_text(yaml.safe_dump({f"block_{b}": {f: None if math.isnan(sig[f]) else sig[f] for f in names} for b, names in features.BLOCKS.items()}, sort_keys=False))


def from_yaml(path: str) -> Signature:
    """KeyError names a block that is missing."""
    import yaml

    x, values = yaml.safe_load(Path(path).read_text()) or {}, {}
    for b in features.BLOCKS:
        if f"block_{b}" not in x:
            raise KeyError(f"block_{b}")
        values |= {f: math.nan if v is None else float(v) for f, v in x[f"block_{b}"].items()}
    return Signature(values)


def flat_copy(root: str, out: str) -> list[str]:
    """Copy each graph's ``signature.json`` to ``<out>/<name>.json``; the names."""
    Path(out).mkdir(parents=True, exist_ok=True)
    done = []
    for name in graph_names(root):
        at = graph_dir(root, name) / "signature" / "signature.json"
        if at.exists():
            (Path(out) / f"{name}.json").write_text(at.read_text())
            done.append(name)
    return done


#: Key and kinds of tagged values in block files (fixed values).
TAG = "__sig_type__"
TAGS = ("ndarray", "PowerLawStats", "tuple", "dict")


def untag(x):
    """A value of a tagged block file in plain Python: arrays, tuples and fits become lists, tagged mappings dictionaries."""
    match x:
        case {"__sig_type__": "dict", "items": items}:
            return {untag(k): untag(v) for k, v in items}
        case {"__sig_type__": kind, "data": data} if kind in TAGS:
            return untag(data)
        case {"__sig_type__": kind}:
            raise ValueError(f"unknown tag: {kind}")
        case dict():
            return {k: untag(v) for k, v in x.items()}
        case list():
            return list(map(untag, x))
    return x


def tag(x):
    """The tagged form of plain values, numpy arrays and numbers; TypeError for anything else."""
    if hasattr(x, "dtype"):
        return {TAG: "ndarray", "dtype": str(x.dtype), "data": x.tolist()} if getattr(x, "ndim", 0) else x.item()
    match x:
        case None | bool() | int() | float() | str():
            return x
        case list():
            return list(map(tag, x))
        case tuple():
            return {TAG: "tuple", "data": list(map(tag, x))}
        case dict():
            return {TAG: "dict", "items": [[tag(k), tag(v)] for k, v in x.items()]}
    raise TypeError(f"no tagged form for {type(x).__name__}")


def read_tagged(path: str) -> dict:
    """A tagged block file as plain values by field."""
    return {k: untag(v) for k, v in json.loads(Path(path).read_text()).items()}


def write_tagged(fields: dict, path: str) -> None:
    Path(path).write_text(json.dumps({k.removeprefix("_"): tag(v) for k, v in fields.items()}, indent=1))


def aggregate(spark: SparkSession, root: str) -> DataFrame:
    """``(graph, feature, value)`` of all signatures of a corpus."""
    return read_corpus(spark, f"{root}/*/signature/signature.json").select(F.col("graph"), "feature", "value")


def measured_or_cached(spark: SparkSession, root: str, name: str, blocks: list[str] | None = None) -> Signature:
    """A graph's signature from its files; blocks that have none are measured from the graph's file."""
    from ..operators import signature
    from . import rdf

    folder = graph_dir(root, name)
    have = folder / "signature"
    sig = read_signature(str(have)) if have.is_dir() and any(have.iterdir()) else Signature()
    lack = [b for b in (blocks or list(features.BLOCKS)) if all(math.isnan(sig[f]) for f in features.BLOCKS[b])]
    if lack:
        file = graph_file(folder)
        if file is None:
            raise FileNotFoundError(f"{name}: no file to measure blocks {lack} from")
        sig = Signature({**sig, **{f: v for f, v in signature.measure(rdf.load(spark, str(file)), lack).items() if features.BLOCK_OF[f] in lack}})
    return sig
