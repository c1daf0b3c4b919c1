"""Language identification with a bidirectional gated recurrent network over bytes.

Two gated recurrent networks read the bytes from the left and from the right;
at each position a linear layer on both states gives the languages'
probabilities; a document's are the mean over its positions.  The network is
trained on the driver, in numpy, by backpropagation through time on a bounded
sample of labelled rows.  Texts are read whole, in segments of ``SEGMENT``
bytes that are columns of one matrix, so a step serves thousands of segments.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

UNKNOWN = "und"
#: Width of each direction; bytes of a segment; bound on the training sample per language; training steps; languages learnt at most.
WIDTH, SEGMENT, SAMPLE, STEPS, LANGUAGES = 12, 128, 600, 400, 256
#: In the pipeline: share of the held-out texts of a language below the bound but for the slack in log-probability; the fewest to go by; characters of a text that are learnt from.
REJECT, SLACK, FEWEST, LEARNT = 0.001, 1.0, 20, 2048


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class Network:
    """Parameters by name, float32; matrices act on columns."""

    def __init__(self, labels: list[str], width: int = WIDTH, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.labels, self.width = labels, width
        w = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        self.p = {f"{n}_{d}": x for d in "fb" for n, x in (("x", w(3 * width, 256)), ("h", w(3 * width, width)), ("b", np.zeros((3 * width, 1), np.float32)), ("v", w(len(labels), width)))}
        self.p["c"] = np.zeros((len(labels), 1), np.float32)

    def _states(self, data: np.ndarray, d: str, keep: list | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """States of one direction at each position (time, columns); the gates go to ``keep``."""
        k, table, hh = self.width, self.p[f"x_{d}"] + self.p[f"b_{d}"], self.p[f"h_{d}"]
        h = np.zeros((k, data.shape[1]), np.float32)
        for t in range(len(data)) if d == "f" else range(len(data) - 1, -1, -1):
            gx, gh = table.take(data[t], axis=1), hh @ h
            zr = gx[: 2 * k]
            zr += gh[: 2 * k]
            _sigmoid(zr)
            z, r = zr[:k], zr[k:]
            n = gx[2 * k :]
            n += r * gh[2 * k :]
            np.tanh(n, out=n)
            before = h
            h = h - n
            h *= z
            h += n
            if keep is not None:
                keep.append((t, before, z, r, n, gh[2 * k :]))
            yield t, h

    def scores(self, data: np.ndarray) -> np.ndarray:
        """Unnormalised log-probabilities (time, label, column)."""
        out = np.empty((len(data), len(self.labels), data.shape[1]), np.float32)
        for t, h in self._states(data, "f"):
            np.matmul(self.p["v_f"], h, out=out[t])
        for t, h in self._states(data, "b"):
            out[t] += self.p["v_b"] @ h
        out += self.p["c"]
        return out

    @staticmethod
    def _softmax(s: np.ndarray) -> np.ndarray:
        s -= s.max(1, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(1, keepdims=True)
        return s

    def positions(self, data: np.ndarray) -> np.ndarray:
        return self._softmax(self.scores(data))

    def gradients(self, data: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions and its derivatives; ``target`` has a label per column."""
        k, (steps, n) = self.width, data.shape
        g = {a: np.zeros_like(b) for a, b in self.p.items()}
        states, kept = {}, {"f": [], "b": []}
        for d in "fb":
            states[d] = dict(self._states(data, d, kept[d]))
        s = np.stack([self.p["v_f"] @ states["f"][t] + self.p["v_b"] @ states["b"][t] + self.p["c"] for t in range(steps)])
        p = self._softmax(s)
        cols = np.arange(n)
        loss = float(-np.log(p[:, target, cols] + 1e-9).mean())
        p[:, target, cols] -= 1
        p /= steps * n
        g["c"] += p.sum((0, 2))[:, None]
        for d in "fb":
            v, hh, dh = self.p[f"v_{d}"], self.p[f"h_{d}"], np.zeros((k, n), np.float32)
            by_byte = np.zeros((256, 3 * k), np.float32)
            for t, before, z, r, m, u in reversed(kept[d]):
                g[f"v_{d}"] += p[t] @ states[d][t].T
                dh = dh + v.T @ p[t]
                dm = dh * (1 - z) * (1 - m * m)
                dz = dh * (before - m) * z * (1 - z)
                dr = dm * u * r * (1 - r)
                dx = np.concatenate([dz, dr, dm])
                dg = np.concatenate([dz, dr, dm * r])
                g[f"h_{d}"] += dg @ before.T
                np.add.at(by_byte, data[t], dx.T)
                dh = dh * z + hh.T @ dg
            g[f"x_{d}"] += by_byte.T
            g[f"b_{d}"] += by_byte.sum(0)[:, None]
        return loss, g

    def train(self, data: np.ndarray, target: np.ndarray, steps: int = STEPS, batch: int = 128, rate: float = 0.02, seed: int = 0) -> float:
        """Adam over random batches; ``data`` is (rows, bytes).  Returns the last losses' mean."""
        rng, losses = np.random.default_rng(seed), []
        m = {a: np.zeros_like(b) for a, b in self.p.items()}
        s = {a: np.zeros_like(b) for a, b in self.p.items()}
        for i in range(1, steps + 1):
            some = rng.integers(0, len(data), batch)
            loss, g = self.gradients(np.ascontiguousarray(data[some].T), target[some])
            losses.append(loss)
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            fall = rate * min(1.0, 1.0 / (norm + 1e-9)) if norm > 1 else rate
            fall *= 0.5 * (1 + np.cos(np.pi * i / steps)) + 0.02
            for a in self.p:
                m[a] += 0.1 * (g[a] - m[a])
                s[a] += 0.01 * (g[a] * g[a] - s[a])
                self.p[a] -= fall * (m[a] / (1 - 0.9**i)) / (np.sqrt(s[a] / (1 - 0.99**i)) + 1e-8)
        return float(np.mean(losses[-20:])) if losses else 0.0

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over all positions of each text (rows of zeros for empty texts)."""
        sizes = np.array([len(t) for t in texts], np.int64)
        n_seg = -(-sizes // SEGMENT)
        out = np.zeros((len(texts), len(self.labels)))
        if not n_seg.sum():
            return out
        flat = np.full(int(n_seg.sum()) * SEGMENT, 32, np.uint8)
        first = np.cumsum(n_seg) - n_seg
        for at, t in zip(first.tolist(), texts, strict=True):
            flat[at * SEGMENT : at * SEGMENT + len(t)] = np.frombuffer(t, np.uint8)
        data = flat.reshape(-1, SEGMENT)
        doc = np.repeat(np.arange(len(texts)), n_seg)
        used = np.minimum(sizes[doc] - (np.arange(len(doc)) - first[doc]) * SEGMENT, SEGMENT)
        for lo in range(0, len(data), 4096):
            s = slice(lo, lo + 4096)
            p = self.positions(np.ascontiguousarray(data[s].T))
            short = used[s] < SEGMENT
            total = p.sum(0)  # label, column
            if short.any():  # what pads a text's last segment doesn't count
                c = np.flatnonzero(short)
                mask = (np.arange(SEGMENT)[:, None] < used[s][c][None, :]).astype(np.float32)
                total[:, c] = np.einsum("tlc,tc->lc", p[:, :, c], mask)
            for i in range(len(self.labels)):
                out[:, i] += np.bincount(doc[s], total[i], len(texts))
        return out / np.maximum(sizes, 1)[:, None]


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; no for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _languages(rows: DataFrame, most: int = LANGUAGES) -> dict[str, int]:
    """Documents of each language, of the ``most`` most frequent ones."""
    n = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return {r.lang: r.n for r in n.orderBy(F.desc("n"), "lang").limit(most).collect()}


def _share(counts: dict[str, int], sample: int) -> F.Column:
    """The share of its language's documents that is drawn: 0 for a language that is not learnt."""
    shares = {lang: min(1.0, sample / n) for lang, n in counts.items()}
    return F.coalesce(F.element_at(F.from_json(F.lit(json.dumps(shares)), "map<string,double>"), F.col("lang")), F.lit(0.0))


def fit(docs: DataFrame, *, sample: int = SAMPLE, steps: int = STEPS, width: int = WIDTH, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Train on about ``sample`` segments per language, at most twice as many, drawn by hash over all rows that may be learnt from.

    Rows that are held out or without language take no part, nor do texts without
    a letter; of more than ``LANGUAGES`` languages the most frequent are learnt.  None if nothing is left to learn from.
    """
    free = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter(~held_out("doc_id") & F.col("lang").isNotNull())
    counts = _languages(free)
    if not counts:
        return None
    share = _share(counts, sample)
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.length("text")), F.lit(1 << 20)) / float(1 << 20)
    # a segment from anywhere in the drawn text
    size = F.length("text")
    place = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.greatest(size - SEGMENT, F.lit(1))).cast("int") + 1
    drawn = free.filter((draw < share) & F.col("text").rlike(r"\p{L}")).select("lang", F.substring("text", place, F.lit(SEGMENT)).alias("t"))
    rows = sorted((r.lang, r.t) for r in drawn.limit(2 * sample * len(counts)).collect())
    labels = sorted({lang for lang, _ in rows})
    if not labels:
        return None
    data = np.full((len(rows), SEGMENT), 32, np.uint8)
    for i, (_, t) in enumerate(rows):
        raw = t.encode()[:SEGMENT]
        data[i, : len(raw)] = np.frombuffer(raw, np.uint8)
    net = Network(labels, width, seed)
    # languages weigh alike
    target = np.array([labels.index(lang) for lang, _ in rows])
    each = max(np.bincount(target))
    order = np.concatenate([np.resize(np.flatnonzero(target == k), each) for k in range(len(labels))])
    net.train(data[order], target[order], steps, seed=seed)
    return net


class Known:
    """How usual a text's pairs of bytes are in each language, and from where on it is none of the language's.

    The network only shares a text out among its languages; this says whether the
    text is in the chosen one at all.  ``cut`` has the lowest mean log-probability
    for each language and each power of two of bytes.
    """

    def __init__(self, texts: dict[str, list[str]], held: dict[str, list[str]]):
        self.table, self.cut = {}, {}
        for lang, some in texts.items():
            n = np.zeros(1 << 16)
            for t in some:
                n += np.bincount(self.pairs(t), minlength=1 << 16)
            n = n.reshape(256, 256)
            first = (n.sum(0) + 0.01) / (n.sum() + 2.56)
            self.table[lang] = np.log((n + 2 * first) / (n.sum(1, keepdims=True) + 2)).astype(np.float32).ravel()
        pool = [(lang, t) for lang, some in held.items() if lang in self.table for t in some]
        for lang, some in texts.items():
            own = [(lang, t) for t in held.get(lang, [])]
            if len(own) >= FEWEST:
                self.cut[lang] = self._cuts(own)
            elif len(pool) >= FEWEST and len(some) >= FEWEST:  # too few of its own: those of all languages, each in its own
                self.cut[lang] = self._cuts(pool)

    @staticmethod
    def pairs(text: str) -> np.ndarray:
        x = np.frombuffer(text.lower().encode(), np.uint8).astype(np.int32)
        return x[:-1] * 256 + x[1:]

    def _cuts(self, texts: list[tuple[str, str]]) -> list[float]:
        """Lowest means by power of two, from beginnings of that many pairs; few long texts go by the shorter ones."""
        at: list[list[float]] = []
        for lang, t in texts:
            x = np.cumsum(self.table[lang][self.pairs(t)], dtype=np.float64)
            for i in range(len(x).bit_length()):
                if i == len(at):
                    at.append([])
                at[i].append(x[(1 << i) - 1] / (1 << i))
        out: list[float] = []
        for means in at:
            out.append(float(np.quantile(means, REJECT)) - SLACK if len(means) >= FEWEST else out[-1] if out else -np.inf)
        return out

    def has(self, text: str, lang: str) -> bool:
        cut, x = self.cut.get(lang), self.pairs(text)
        if not cut or not len(x):
            return True
        return float(self.table[lang][x].mean()) >= cut[min(len(x).bit_length(), len(cut)) - 1]


def fit_known(docs: DataFrame, *, sample: int = SAMPLE, seed: int = 0) -> Known:
    """From about ``sample`` texts per language to learn from and as many held-out ones, at most twice as many, drawn by hash over all rows."""
    x = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), held_out().alias("held")).filter(F.col("lang").isNotNull())
    of = {held: _languages(x.filter(F.col("held") == held)) for held in (False, True)}
    share = F.when(F.col("held"), _share(of[True], sample)).otherwise(_share(of[False], sample))
    draw = F.pmod(F.xxhash64(F.lit(seed + 2), "doc_id", F.length("text")), F.lit(1 << 20)) / float(1 << 20)
    drawn = x.filter((draw < share) & F.col("text").rlike(r"\p{L}")).select("lang", "held", F.substring("text", 1, LEARNT).alias("t"))
    by: dict[bool, dict[str, list[str]]] = {False: {}, True: {}}
    for r in drawn.limit(2 * sample * max(1, len(of[False]) + len(of[True]))).collect():
        by[r.held].setdefault(r.lang, []).append(r.t)
    return Known(by[False], by[True])


_SCHEMA = pa.schema([("lang_pred", pa.string()), ("score", pa.float64())])


def _predict(net: Network | None, text_col: str, names: list[str], known: Known | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.slices(batches, text_col, 4 << 20):
            raw = shared.texts(b, text_col)
            p = net.documents([t or b"" for t in raw]) if net else np.zeros((len(raw), 1))
            best = p.argmax(1)
            lang = [net.labels[k] if net and t and any(map(str.isalpha, t.decode())) else UNKNOWN for t, k in zip(raw, best.tolist(), strict=True)]
            if known:
                lang = [x if x == UNKNOWN or known.has(t.decode(), x) else UNKNOWN for t, x in zip(raw, lang, strict=True)]
            score = [0.0 if x == UNKNOWN else float(min(1.0, s)) for x, s in zip(lang, p.max(1).tolist(), strict=True)]
            new = {"_lang": pa.array(lang, pa.string()), "_score": pa.array(score, pa.float64())}
            yield pa.RecordBatch.from_arrays([new[n] if n in new else b.column(b.schema.get_field_index(n)) for n in names], names=names)

    return shared.tidy(run)


def identify(docs: DataFrame, net: Network | None, *, text_col: str = "text", known: Known | None = None) -> DataFrame:
    """The rows with all columns, ``_lang`` and ``_score`` (input columns of these names go).

    ``_lang`` is the language with the largest mean probability over the whole
    text's positions, ``und`` with score 0 where the text is null or has no letter
    or there is no network, and with ``known`` where it is not in that language.  An empty table gives an empty table.
    """
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    shared.ship(docs.sparkSession)
    docs = docs.drop("_lang", "_score").withColumn(text_col, F.col(text_col).cast("string"))
    out = StructType([*docs.schema.fields, StructField("_lang", StringType()), StructField("_score", DoubleType())])
    return docs.mapInArrow(_predict(net, text_col, out.names, known), out)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document, learnt from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    x = identify(docs.select("doc_id", "text"), fit(docs))
    return x.select("doc_id", held_out().alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
