import hashlib
import random

import numpy as np
import pytest
from tripleloom.llm import nearjoin, suffixes, vectors


def brute_near(rows, threshold=0.8):
    """Links, classes and components of (row, id, text), over all pairs."""

    def grams(t):
        w = (t or "").lower().encode().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])

    sets = [grams(t) for _, t in rows]
    n = len(rows)
    link = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or (both and both >= threshold * len(sets[i] | sets[j])):
                link[i].append(j)
                link[j].append(i)
    low = [-(2**63) if d is None else d for d, _ in rows]
    comp, seen = [0] * n, set()
    for i in range(n):
        if i not in seen:
            part, todo = [], [i]
            seen.add(i)
            while todo:
                x = todo.pop()
                part.append(x)
                for y in link[x]:
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
            for x in part:
                comp[x] = min(low[y] for y in part)
    cls = [min(low[j] for j in range(n) if sets[j] == sets[i]) for i in range(n)]
    return sorted((low[i], cls[i], len(link[i]), comp[i]) for i in range(n))


def got_near(docs, **more):
    rows = nearjoin.near_duplicates(nearjoin.keyed(docs), **more).collect()
    low = lambda x: -(2**63) if x is None else x
    heads = {}
    for r in rows:
        heads[low(r.component_id)] = heads.get(low(r.component_id), 0) + r.kept
    assert all(v == 1 for v in heads.values())
    return sorted((low(r.doc_id), low(r.class_id), r.n_links, low(r.component_id)) for r in rows)


def variants(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for base in range(n):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 8, 60, 120]))]
        for _ in range(rng.choice([1, 2, 5])):
            w = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("name", ["docs", "odd", "none"])
def test_join_equals_brute_force(request, name):
    docs = request.getfixturevalue(name).select("doc_id", "text")
    assert got_near(docs) == brute_near([(r.doc_id, r.text) for r in docs.collect()])


def test_join_of_variants_and_of_one_large_group(spark, monkeypatch):
    rows = variants(60)
    rng = random.Random(1)
    base = [f"b{i}" for i in range(150)]
    for _ in range(70):
        w = list(base)
        w[rng.randrange(150)] = f"y{rng.randrange(10**6)}"
        w[rng.randrange(150)] = f"y{rng.randrange(10**6)}"
        rows.append((len(rows), " ".join(w)))
    want = brute_near(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got_near(docs) == want
    # the same through grids of small blocks
    monkeypatch.setattr(nearjoin, "CHUNK", 16)
    assert got_near(docs) == want


def test_pruning_bounds():
    need = nearjoin.needed(0.8, 1e-7)
    assert need == sorted(need) and need[-1] < 128 * 0.8
    from math import comb

    n = 32
    tail = lambda m: sum(comb(n + 1, i) * 0.8**i * 0.2 ** (n + 1 - i) for i in range(m + 1))
    assert tail(need[0]) >= 1e-7 > tail(need[0] - 1)
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, 120, dtype=np.uint64)) for _ in range(40)]
    common = nearjoin.intersections(sets)
    assert all(common[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(40) for j in range(40))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    x = nearjoin._spread(rng.integers(0, 2**62, 3000, dtype=np.uint64))
    a, b = x[:2000], x[400:2400]
    sig = nearjoin.signatures([np.unique(a), np.unique(b)])
    assert (sig[0] == sig[1]).mean() == pytest.approx(1600 / 2400, abs=0.12)


def brute_vectors(rows, threshold=0.93):
    out, ok = [], []
    for _, v, label in rows:
        x = None if v is None or label is None or any(y is None for y in v) else np.array(v, float)
        ok.append(x if x is not None and len(x) and np.isfinite(x).all() and np.abs(x).max() > 0 else None)
    n = len(rows)
    link = [[j for j in range(n) if j != i and ok[i] is not None and ok[j] is not None and len(ok[i]) == len(ok[j]) and rows[i][2] == rows[j][2] and ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= threshold] for i in range(n)]
    for i in range(n):
        part, todo = {i}, [i]
        while todo:
            for y in link[todo.pop()]:
                if y not in part:
                    part.add(y)
                    todo.append(y)
        out.append((rows[i][0], len(link[i]), min(rows[y][0] for y in part)))
    return sorted(out)


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = []
    for base in range(60):
        v = rng.standard_normal(24)
        for _ in range(int(rng.choice([1, 1, 2, 9]))):
            rows.append((len(rows), [float(x) for x in v + rng.standard_normal(24) * rng.choice([0.0, 0.05, 0.1])], int(rng.integers(0, 3))))
    same = [float(x) for x in rng.standard_normal(24)]
    rows += [(len(rows) + i, same, 1) for i in range(20)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 24, 1), (n + 2, [float("nan")] * 24, 1), (n + 3, [None, 1.0], 1), (n + 4, same, None), (n + 5, [], 1), (n + 6, same[:5], 1), (n + 7, [x * 1e200 for x in same], 1), (n + 8, [x * 1e-200 for x in same], 1), (n + 9, [float("inf")] + same[1:], 1), (n + 10, same[:5], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4).selectExpr("*", "'x' as cid", "1 as list", "2 as vec")
    want = brute_vectors([r if r[0] not in (n + 7, n + 8) else (r[0], same, 1) for r in rows])
    for chunk in (vectors.CHUNK, 8):
        got = vectors.near_vectors(df, chunk=chunk).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert vectors.near_vectors(df.limit(0)).count() == 0
    assert vectors.near_vectors(df.filter("label is null")).first().n_links == 0


def test_vector_recall_on_the_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    want = ((x @ x.T >= 0.93) & (label[:, None] == label[None])).sum() - len(x)
    got = sum(r.n_links for r in vectors.near_vectors(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).collect())
    assert got == want  # this table holds no link; test_planted_vectors.py measures recall


def brute_repeats(rows, w=100):
    seen, out = set(), []
    for n, (doc, text) in sorted(enumerate(rows), key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0])):
        raw = (text or "").encode()
        mark = bytearray(len(raw))
        for p in range(len(raw) - w + 1):
            if raw[p : p + w] in seen:
                mark[p : p + w] = b"\1" * w
            seen.add(raw[p : p + w])
        kept = bytes(c for c, m in zip(raw, mark, strict=True) if not m)
        spans = sum(m and not (i and mark[i - 1]) for i, m in enumerate(mark))
        out.append((doc is not None, doc or 0, len(raw), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got_repeats(docs):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffixes.remove_repeats(docs).collect())


@pytest.mark.parametrize("name", ["docs", "none"])
def test_repeats_equal_brute_force(request, name):
    docs = request.getfixturevalue(name)
    want = brute_repeats([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert got_repeats(docs) == want


def test_repeats_of_odd_texts(spark, odd, monkeypatch):
    small = odd.filter("doc_id is null or doc_id <> 7")
    assert got_repeats(small) == brute_repeats([(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()])
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(0, 150))) + passage[rng.randrange(100) : rng.randrange(250, 400)] + "".join(rng.choice("éü漢 ") for _ in range(40))) for i in range(60)]
    rows += [(70, "a" * 500), (71, "a" * 99), (72, "a" * 100), (73, "ab" * 300), (74, passage * 3), (75, passage), (75, passage), (None, passage), (76, ("x" * 30 + "y") * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_repeats(rows)
    assert got_repeats(docs.coalesce(1)) == want
    monkeypatch.setattr(suffixes, "PART", 300)
    assert got_repeats(docs.coalesce(1)) == want
    monkeypatch.setattr(suffixes, "HOT", 3)  # anchors in the middle of the passage take the other way
    assert got_repeats(docs.coalesce(1)) == want


def test_trie_and_suffix_order():
    rng = random.Random(2)
    strings = [bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(200)]
    groups = suffixes.BlindTrie(strings).groups()
    assert [strings[g[0]] for g in groups] == sorted(set(strings)) and all(len({strings[i] for i in g}) == 1 for g in groups)
    flat = bytes(rng.choice(b"abc") for _ in range(300)) * 2 + b"\0" * 100
    starts = np.arange(500)
    group = np.array([rng.randrange(3) for _ in starts])
    order, same = suffixes.sort_suffixes(flat, starts, group)
    key = [(group[i], flat[starts[i] : starts[i] + 100]) for i in order]
    assert key == sorted(key) and [a == b for a, b in zip(key, key[1:], strict=False)] == same[1:].tolist()
