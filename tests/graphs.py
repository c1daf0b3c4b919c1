"""Small graphs, and counts by enumeration."""

from itertools import combinations

import numpy as np
from tripleloom.plans.graph import RDF_TYPE, Graph

SMALL = "/root/testdata/sf0.001"
SCHEMA = "s string, p string, o string, o_is_literal boolean"


def graph(spark, *triples):
    """Triples (s, p, o); an o that starts with a quote is a literal, ``type`` is rdf:type."""
    rows = [(s, RDF_TYPE if p == "type" else p, o.strip('"'), o.startswith('"')) for s, p, o in triples]
    return Graph(spark.createDataFrame(rows, SCHEMA))


def undirected(spark, edges):
    return graph(spark, *((f"v{min(a, b):03d}", "r", f"v{max(a, b):03d}") for a, b in edges))


def random_edges(n, p, seed):
    rng = np.random.default_rng(seed)
    return [e for e in combinations(range(n), 2) if rng.random() < p]


def adjacency(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def kinds(edges, k):
    """Connected induced subgraphs of k vertices by sorted degrees."""
    near, out = adjacency(edges), {}
    for vs in combinations(sorted(near), k):
        inside = {v: near[v] & set(vs) for v in vs}
        seen, todo = {vs[0]}, [vs[0]]
        while todo:
            for w in inside[todo.pop()] - seen:
                seen.add(w)
                todo.append(w)
        if len(seen) == k:
            ds = ",".join(map(str, sorted(map(len, inside.values()))))
            out[ds] = out.get(ds, 0) + 1
    return out


def stars(edges, k):
    near = adjacency(edges)
    return sum(all(b not in near[a] for a, b in combinations(leaf, 2)) for v in near for leaf in combinations(sorted(near[v]), k))
