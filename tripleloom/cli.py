"""Command line: measure, generate, compare, dataset."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tripleloom")
    sub = p.add_subparsers(dest="command", required=True)
    m = sub.add_parser("measure", help="measure a graph's signature")
    m.add_argument("graph")
    m.add_argument("--out")
    m.add_argument("--blocks", default="a,b,c,d,e,f")
    g = sub.add_parser("generate", help="make a graph for a signature")
    g.add_argument("signature")
    g.add_argument("--out", required=True)
    g.add_argument("--seed", type=int, default=0)
    g.add_argument("--budget", type=int, default=50_000)
    g.add_argument("--chains", type=int, default=1)
    g.add_argument("--measure", metavar="FILE", help="measure the graph that was made and write its signature")
    c = sub.add_parser("compare", help="compare two graphs or signatures")
    c.add_argument("target")
    c.add_argument("achieved")
    c.add_argument("--blocks", default="a,b,c,d,e,f")
    d = sub.add_parser("dataset", help="make a batch of perturbed graphs")
    d.add_argument("config")
    d.add_argument("--base", required=True, help="signature file of the base graph")
    d.add_argument("--out-dir")
    d.add_argument("--dry-run", action="store_true")
    d.add_argument("--force", action="store_true")
    return p


def _signature(spark: SparkSession, path: str, blocks: list[str]):
    from .operators import signature
    from .sources import rdf

    if path.endswith(".json"):
        return signature.Signature.from_json(Path(path).read_text())
    return signature.measure(rdf.load(spark, path), blocks)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tripleloom").getOrCreate()
    if args.command == "measure":
        sig = _signature(spark, args.graph, args.blocks.split(","))
        if args.out:
            Path(args.out).parent.mkdir(parents=True, exist_ok=True)
            Path(args.out).write_text(sig.to_json(args.graph))
        print(sig.summary())
    elif args.command == "generate":
        from .generator.rewire import generate
        from .operators.signature import Signature
        from .sources import rdf

        g = generate(spark, Signature.from_json(Path(args.signature).read_text()), args.seed, args.budget, args.chains)
        rdf.save(g.edges, args.out, "nt", mode="overwrite")
        print(f"{g.edges.count()} triples in {args.out}")
        if args.measure:
            from .operators import signature

            Path(args.measure).write_text(signature.measure(g).to_json(args.out))
    elif args.command == "compare":
        from .operators import compare

        a, b = (_signature(spark, x, args.blocks.split(",")) for x in (args.target, args.achieved))
        e = compare.relative_errors(a.table(spark), b.table(spark)).cache()
        e.orderBy("feature").show(200, False)
        print(compare.summary(e).first().asDict())
        full = compare.report(spark, a, b).cache()
        full.orderBy("block", "kind", "name").show(200, False)
        full.groupBy("block", "kind").agg({"error": "median"}).orderBy("block", "kind").show()
    else:
        from . import dataset
        from .operators.signature import Signature

        config = dataset.Config.from_yaml(args.config, args.out_dir)
        if args.dry_run:
            print(dataset.describe(spark, config))
            return 0
        rows = dataset.run(spark, config, Signature.from_json(Path(args.base).read_text()), args.force)
        print(f"{sum(r['ok'] for r in rows)} of {len(rows)} graphs made")
        return int(not all(r["ok"] for r in rows))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
