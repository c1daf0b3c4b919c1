"""Stage three: rewiring towards motif counts by simulated annealing.

A chain of edge swaps is sequential, so a chain is one task; several chains with
different seeds run side by side and the best is kept.  Counts are kept by what
changes around a swapped edge, never by counting again.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import RDF_TYPE, Graph

TERMS = ("triangle_count", "four_cycle_count", "diamond_count", "k4_count", "tailed_triangle_count")
CYCLES = {"five_cycle_count": 5, "six_cycle_count": 6}
#: Terms that are kept up to date only when a target asks for them.
MORE = (*CYCLES, "clustering_coefficient", "degree_assortativity")
#: Features that this stage reads.
READS = dict.fromkeys((*TERMS, *MORE), "")


class State:
    """An undirected simple graph under edge changes, with its triangles, 4-motifs and degree products."""

    def __init__(self, pairs: Iterator[tuple], more: tuple[str, ...] = (), guard: float = math.inf):
        self.near: dict = {}
        self.many: dict = {}
        self.counts: dict[str, float] = dict.fromkeys((*TERMS, *more), 0)
        self.cycles = [(t, CYCLES[t]) for t in more if t in CYCLES]
        self.local = "clustering_coefficient" in more
        self.mixing = "degree_assortativity" in more
        self.guard, self.corners, self.share = guard, {}, 0.0
        self.passed_over = 0  # changes whose cycles were not counted
        pairs = list(pairs)
        # ends counted with repeats; a swap changes no vertex's number of ends
        self.ends: dict = {}
        self.products = 0
        for u, v in pairs:
            for x in (u, v):
                self.ends[x] = self.ends.get(x, 0) + 1
        m = sum(self.ends.values()) or 1
        mean = sum(d * d for d in self.ends.values()) / m
        self.moments = m, mean, sum(d**3 for d in self.ends.values()) / m - mean * mean
        for u, v in pairs:
            self.add(u, v)

    def _paths(self, u, v, length: int, allowed=None) -> Iterator[tuple]:
        """Interiors of the chordless paths from u to v with this number of inner vertices (u-v itself not looked at)."""
        near = self.near

        def grow(path: tuple, banned: set):
            last = path[-1] if path else u
            if len(path) == length:
                if v in near[last]:
                    yield path
                return
            for w in near[last] - banned:
                if w == v or (len(path) + 1 < length and v in near[w]):
                    continue
                # w may touch only the vertex before it
                yield from grow((*path, w), banned | near[last] | {w})

        yield from grow((), {u, v})

    def _rings(self, u, v, k: int) -> int:
        """What the edge u-v (absent now) would add to the induced k-cycles: those through it, less those it cuts.

        Ends beyond a degree guard, if one is set, are passed over: the change counts
        as none, and ``passed_over`` says how often.
        """
        if any(len(self.near[x]) > self.guard for x in (u, v)):
            self.passed_over += 1
            return 0
        made = sum(1 for _ in self._paths(u, v, k - 2))
        cut = 0
        for i in range(1, (k - 2) // 2 + 1):
            short, long_ = list(self._paths(u, v, i)), list(self._paths(u, v, k - 2 - i))
            for a, p in enumerate(short):
                for b, q in enumerate(long_):
                    if i == k - 2 - i and b <= a:
                        continue
                    if not set(p) & set(q) and not any(self.near[x] & set(q) for x in p):
                        cut += 1
        return made - cut

    def _corner(self, x, by: int, d_before: int, d_after: int) -> None:
        """Triangles at a vertex change, and with its degree its share of closed pairs."""
        value = lambda t, d: 2 * t / (d * (d - 1)) if d > 1 else 0.0
        t = self.corners.get(x, 0)
        self.share += value(t + by, d_after) - value(t, d_before)
        self.corners[x] = t + by

    def _other(self, u, v, sign: int) -> None:
        """Update the terms of :data:`MORE` for an edge that is absent now and comes (1) or has gone (-1)."""
        for t, k in self.cycles:
            self.counts[t] += sign * self._rings(u, v, k)
        if self.local:
            common = self.near[u] & self.near[v]
            for x in (u, v):
                d = len(self.near[x])
                self._corner(x, sign * len(common), d if sign > 0 else d + 1, d + 1 if sign > 0 else d)
            for x in common:
                d = len(self.near[x])
                self._corner(x, sign, d, d)
            self.counts["clustering_coefficient"] = self.share / max(1, len(self.near))

    def _mix(self, u, v, sign: int) -> None:
        """Correlation of the numbers of ends at both sides of the edges, from the sum of their products."""
        if not self.mixing:
            return
        self.products += sign * self.ends[u] * self.ends[v]
        m, mean, var = self.moments
        self.counts["degree_assortativity"] = (2 * self.products / m - mean * mean) / var if var > 0 else 0.0

    def _around(self, u, v) -> tuple[int, int, int, int, int]:
        """Induced subgraphs of three and four vertices that hold the edge u-v: triangles, 4-cycles, diamonds, K4, tailed triangles."""
        near = self.near
        nu, nv = near[u] - {v}, near[v] - {u}
        both, only_u, only_v = nu & nv, nu - nv, nv - nu
        cycles = sum(len(near[a] & only_v) for a in only_u)
        k4 = diamonds = paws = 0
        for a, b in combinations(both, 2):
            if b in near[a]:
                k4 += 1
            else:
                diamonds += 1
        for w in both:  # with a neighbour of exactly one of u, v that w also knows
            diamonds += len(near[w] & only_u) + len(near[w] & only_v)
            # w hangs a tail: a neighbour of w alone; or a tail at u or v
            paws += len(near[w] - near[u] - near[v] - {u, v})
            paws += len(only_u - near[w]) + len(only_v - near[w])
        # u-v is the tail of a triangle at u or at v
        for side in (only_u, only_v):
            paws += sum(len(near[a] & side) for a in side) // 2
        return len(both), cycles, diamonds, k4, paws

    def _missing(self, u, v) -> tuple[int, int, int, int, int]:
        """The same 4-vertex sets without the edge u-v: what they are when it is absent."""
        near = self.near
        nu, nv = near[u] - {v}, near[v] - {u}
        both, only_u, only_v = nu & nv, nu - nv, nv - nu
        cycles = diamonds = paws = 0
        for a, b in combinations(both, 2):
            if b in near[a]:
                diamonds += 1
            else:
                cycles += 1
        for w in both:  # path u-w-v with a fourth vertex that closes a triangle with w and one end
            paws += len(near[w] & only_u) + len(near[w] & only_v)
        return 0, cycles, diamonds, 0, paws

    def change(self, u, v) -> list[int]:
        """What adding the edge u-v adds to the counts."""
        for x in (u, v):
            self.near.setdefault(x, set())
        have = v in self.near[u]
        if have:
            self.near[u].discard(v)
            self.near[v].discard(u)
        without, with_ = self._missing(u, v), self._around(u, v)
        if have:
            self.near[u].add(v)
            self.near[v].add(u)
        return [a - b for a, b in zip(with_, without, strict=True)]

    def add(self, u, v) -> None:
        key = (u, v) if u < v else (v, u)
        self._mix(u, v, 1)
        if u == v:
            return
        self.many[key] = self.many.get(key, 0) + 1
        if self.many[key] == 1:
            for t, x in zip(TERMS, self.change(u, v), strict=True):
                self.counts[t] += x
            self._other(u, v, 1)
            self.near[u].add(v)
            self.near[v].add(u)

    def remove(self, u, v) -> None:
        key = (u, v) if u < v else (v, u)
        self._mix(u, v, -1)
        if u == v:
            return
        self.many[key] -= 1
        if not self.many[key]:
            del self.many[key]
            self.near[u].discard(v)
            self.near[v].discard(u)
            for t, x in zip(TERMS, self.change(u, v), strict=True):
                self.counts[t] -= x
            self._other(u, v, -1)


def loss(counts: dict, target: dict, adaptive: bool = True, scale: float = 50.0) -> float:
    """Sum of relative errors, each weighted by itself if adaptive, so that what is far off is pushed hardest."""
    e = [abs(counts[t] - target[t]) / max(1e-9 if t in MORE[2:] else 1.0, abs(target[t])) for t in target]
    return sum(scale * x * x for x in e) if adaptive else sum(e)


def anneal(edges: list[tuple], target: dict[str, float], budget: int, temperature: float = 0.05, cooling: float = 0.9995, seed: int = 0, guard: float = math.inf, errors: list[tuple] | None = None, callback: Callable[[int, list[tuple]], None] | None = None, every: int = 1000) -> tuple[list[tuple], list[tuple]]:
    """The best edges ``(s, p, o)`` seen in ``budget`` swaps of targets within a relation, and the log of the swaps: (step, change of the loss, accepted, largest degree of an end).

    Every ``every`` steps, and at the end, ``errors`` gets (step, term, relative error)
    of each term, and ``callback`` the step and the edges as they are.

    A swap keeps every entity's degrees and relations; loops and repeats are
    refused.  Half of the proposals close an open wedge while triangles lack.
    """
    rng = random.Random(seed)
    edges = list(edges)
    goal = {t: float(target[t]) for t in (*TERMS, *MORE) if t in target and not math.isnan(target[t]) and (t not in MORE or target[t])}
    state, have = State(((s, o) for s, _, o in edges), tuple(t for t in MORE if t in goal), guard), set(edges)
    by: dict = {}
    place: dict = {}
    for k, (s, p, _) in enumerate(edges):
        by.setdefault(p, []).append(k)
        place.setdefault((s, p), []).append(k)
    now = loss(state.counts, goal)
    best, kept, log = now, list(edges), []

    def report(step: int) -> None:
        if errors is not None:
            errors.extend((step, t, abs(state.counts[t] - goal[t]) / max(1e-9 if t in MORE[2:] else 1.0, abs(goal[t]))) for t in goal)
        if callback:
            callback(step, list(edges))

    for step in range(budget if len(edges) > 1 and goal else 0):
        if step % every == 0:
            report(step)
        i = rng.randrange(len(edges))
        s1, p, o1 = edges[i]
        j = rng.choice(by[p])
        if state.counts["triangle_count"] < goal.get("triangle_count", 0) and rng.random() < 0.5 and state.near.get(s1):
            mid = rng.choice(sorted(state.near[s1]))
            ends = sorted(state.near[mid] - {s1})
            if ends:
                want = rng.choice(ends)
                j = next((k for k in rng.sample(by[p], min(50, len(by[p]))) if edges[k][2] == want), j)
        s2, _, o2 = edges[j]
        a, b = (s1, p, o2), (s2, p, o1)
        if i == j or s1 == o2 or s2 == o1 or a in have or b in have or a == b:
            continue
        for s, o in ((s1, o1), (s2, o2)):
            state.remove(s, o)
        for s, o in ((s1, o2), (s2, o1)):
            state.add(s, o)
        new = loss(state.counts, goal)
        ok = new <= now or rng.random() < math.exp(-(new - now) / max(temperature, 1e-12))
        log.append((step, new - now, ok, max(len(state.near[x]) for x in (s1, o1, s2, o2))))
        if ok:
            have -= {edges[i], edges[j]}
            have |= {a, b}
            edges[i], edges[j], now = a, b, new
            temperature *= cooling
            if now < best:
                best, kept = now, list(edges)
        else:
            for s, o in ((s1, o2), (s2, o1)):
                state.remove(s, o)
            for s, o in ((s1, o1), (s2, o2)):
                state.add(s, o)
    report(budget)
    return kept, log


def refine(g: Graph, target: dict[str, float], budget: int = 5000, chains: int = 1, temperature: float = 0.05, cooling: float = 0.9995, seed: int = 0, max_edges: int = 2_000_000, guard: float = math.inf) -> Graph:
    """Rewire a graph's content edges; the chain with the smallest loss wins.

    A chain holds the edges in one task, so graphs beyond ``max_edges`` raise.  With
    a ``guard``, five- and six-cycles at ends of a higher degree are not followed
    while rewiring; the chains are compared, and the winner chosen, without it.

    The graph has ``swaps``, a table (chain, step, delta, accepted, degree) of every
    proposal, and ``convergence``, (chain, step, term, error) of every thousandth step.
    """
    from ..plans.session import ship

    spark = g.edges.sparkSession
    ship(spark)
    content = g.content
    n = content.count()
    if n > max_edges:
        raise ValueError(f"{n} content edges are more than a chain holds ({max_edges})")
    fixed = g.edges.join(content, ["s", "p", "o"], "left_anti")
    copies = content.withColumn("chain", F.explode(F.array(*map(F.lit, range(chains)))))
    goal = {t: v for t, v in target.items() if t in (*TERMS, *MORE) and not math.isnan(v) and (t not in MORE or v)}

    def run(key, pdf):
        import pandas as pd

        errors: list[tuple] = []
        kept, log = anneal(sorted(zip(pdf.s, pdf.p, pdf.o, strict=True)), goal, budget, temperature, cooling, seed + int(key[0]), guard, errors)
        e = loss(State(((s, o) for s, _, o in kept), tuple(t for t in MORE if t in goal)).counts, goal)
        parts = [
            pd.DataFrame(kept, columns=["s", "p", "o"]).assign(kind="edge", loss=e),
            pd.DataFrame(log, columns=["step", "delta", "accepted", "degree"]).assign(kind="swap"), pd.DataFrame(errors, columns=["step", "s", "delta"]).assign(kind="error"),
        ]
        names = ["chain", "kind", "loss", "s", "p", "o", "step", "delta", "accepted", "degree"]
        out = pd.concat([x.reindex(columns=names) for x in parts if len(x)], ignore_index=True).assign(chain=int(key[0]))
        return out.astype({"loss": float, "step": "Int64", "delta": float, "accepted": "boolean", "degree": "Int64"})

    from ..operators.components import checkpointed

    made = checkpointed(copies.groupBy("chain").applyInPandas(run, "chain int, kind string, loss double, s string, p string, o string, step long, delta double, accepted boolean, degree long"))
    best = made.filter("kind = 'edge'").groupBy("chain").agg(F.min("loss").alias("loss")).orderBy("loss", "chain").limit(1).select("chain")
    edges = made.filter("kind = 'edge'").join(F.broadcast(best), "chain").select("s", "p", "o", F.lit(False).alias("o_is_literal"))
    out = Graph(fixed.select("s", "p", "o", "o_is_literal").unionByName(edges), distinct=True)
    out.swaps = made.filter("kind = 'swap'").select("chain", "step", "delta", "accepted", "degree")
    out.convergence = made.filter("kind = 'error'").select("chain", "step", F.col("s").alias("term"), F.col("delta").alias("error"))
    return out


def swap_log(edges: list[tuple], target: dict[str, float], budget: int, spark, seed: int = 0) -> DataFrame:
    """``(step, delta, accepted, degree)`` of one chain."""
    return spark.createDataFrame(anneal(edges, target, budget, seed=seed)[1], "step int, delta double, accepted boolean, degree int")


def generate(spark, values: dict[str, float], seed: int = 0, budget: int = 50_000, chains: int = 1) -> Graph:
    """All three stages."""
    from .schema import sample_schema
    from .wiring import instantiate

    g = instantiate(spark, sample_schema(values, seed))
    return refine(g, values, budget, chains, seed=seed + 2) if budget else g


__all__ = ["RDF_TYPE", "State", "anneal", "generate", "loss", "refine", "swap_log"]
