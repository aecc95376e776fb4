"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes become channels: a learned embedding, and whether a byte equals the one some places back (which
shows repetition). Learned filters run over short windows of bytes; their rectified outputs are averaged in
overlapping chunks that cover the whole text; a second layer rates each chunk; the chunks' ratings are max-pooled
and, with their mean, combined into one probability.

The network is fitted on the driver, on at most FIT_ROWS labelled texts of the learning folds, picked by a hash
of their id; of a long text, it learns from FIT_BYTES at a place that the hash picks. Scoring takes whole texts,
in spans of bounded size.

Defined results: null and empty texts count as one space and get a score like any other; repeated rows are scored
each; without labels of both classes every score is the share of label 1 (or 0.5); other columns are left out;
an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, fold, small_batches

FIT_ROWS, FIT_BYTES, EPOCHS = 2400, 3000, 5
THRESHOLD = 0.3
EMBEDDED, LAGS = 6, (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)
CHANNELS = EMBEDDED + len(LAGS)
WIDTH, STRIDE, FILTERS = 8, 4, 24
#: A chunk is so many windows; chunks begin half as many apart.
CHUNK, RATINGS = 16, 12
SHORTEST = STRIDE * (CHUNK - 1) + WIDTH
#: Bytes scored at once; spans of a longer text overlap by a chunk.
SPAN = 1 << 18


def padded(text: str | None) -> np.ndarray:
    """The text's bytes, at least a chunk of them and a whole number of half chunks beyond."""
    raw = (text or " ").encode() or b" "
    half = STRIDE * CHUNK // 2
    size = max(SHORTEST, SHORTEST + -(-(len(raw) - SHORTEST) // half) * half)
    out = np.full(size, 32, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out


class Network:
    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        self.p = {
            "e": r.normal(0, 0.5, (256, EMBEDDED)), "w1": r.normal(0, (WIDTH * CHANNELS) ** -0.5, (WIDTH * CHANNELS, FILTERS)), "b1": np.zeros(FILTERS),
            "w2": r.normal(0, 0.4, (FILTERS, RATINGS)), "b2": np.zeros(RATINGS), "w3": r.normal(0, 0.3, 2 * RATINGS), "b3": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _windows(self, raw: np.ndarray) -> np.ndarray:
        x = np.zeros((len(raw), CHANNELS), np.float32)
        x[:, :EMBEDDED] = self.p["e"][raw]
        for c, lag in enumerate(LAGS):
            x[lag:, EMBEDDED + c] = raw[lag:] == raw[:-lag]
        n = (len(raw) - WIDTH) // STRIDE + 1
        view = np.lib.stride_tricks.as_strided(x, (n, WIDTH * CHANNELS), (x.strides[0] * STRIDE, x.itemsize))
        return np.ascontiguousarray(view)

    def _chunks(self, z1: np.ndarray) -> np.ndarray:
        half = CHUNK // 2
        sums = z1[: len(z1) // half * half].reshape(-1, half, z1.shape[1]).sum(1)
        return (sums[:-1] + sums[1:]) / CHUNK

    def ratings(self, raw: np.ndarray) -> np.ndarray:
        """Every chunk's ratings."""
        z1 = np.maximum(self._windows(raw) @ self.p["w1"] + self.p["b1"], 0)
        return np.maximum(self._chunks(z1) @ self.p["w2"] + self.p["b2"], 0)

    def logit(self, text: str | None) -> float:
        raw = padded(text)
        top, total, n = np.zeros(RATINGS, np.float32), np.zeros(RATINGS, np.float64), 0
        step = SPAN // (STRIDE * CHUNK) * STRIDE * CHUNK
        for at in range(0, max(1, len(raw) - SHORTEST + 1), step):
            r = self.ratings(raw[at : at + step + SHORTEST - STRIDE * CHUNK // 2])
            top, total, n = np.maximum(top, r.max(0)), total + r.sum(0, dtype=np.float64), n + len(r)
        return float(np.r_[top, total / n] @ self.p["w3"] + self.p["b3"][0])

    def gradients(self, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients over a batch of padded texts."""
        p, g, loss = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}, 0.0
        for raw, target, w in zip(texts, y, weight, strict=True):
            x = self._windows(raw)
            a1 = x @ p["w1"] + p["b1"]
            c = self._chunks(np.maximum(a1, 0))
            a2 = c @ p["w2"] + p["b2"]
            z2 = np.maximum(a2, 0)
            arg = z2.argmax(0)
            pooled = np.r_[z2[arg, np.arange(RATINGS)], z2.mean(0)]
            z = float(pooled @ p["w3"] + p["b3"][0])
            prob = 1 / (1 + np.exp(-z))
            loss -= w * float(np.log(max(1e-9, prob if target else 1 - prob)))
            d = np.float32(w * (prob - target))
            g["w3"] += d * pooled
            g["b3"] += d
            dz2 = np.repeat((d * p["w3"][RATINGS:] / len(z2))[None], len(z2), 0)
            dz2[arg, np.arange(RATINGS)] += d * p["w3"][:RATINGS]
            dz2[a2 <= 0] = 0
            g["w2"] += c.T @ dz2
            g["b2"] += dz2.sum(0)
            dc = dz2 @ p["w2"].T / CHUNK
            halves = np.zeros((len(dc) + 1, FILTERS), np.float32)
            halves[:-1] += dc
            halves[1:] += dc
            da1 = np.zeros_like(a1)
            used = len(halves) * (CHUNK // 2)
            da1[:used] = np.repeat(halves, CHUNK // 2, axis=0)
            da1[a1 <= 0] = 0
            g["w1"] += x.T @ da1
            g["b1"] += da1.sum(0)
            dx = (da1 @ p["w1"].T).reshape(-1, WIDTH, CHANNELS)[:, :, :EMBEDDED]
            for o in range(WIDTH):
                at = raw[o : o + STRIDE * len(dx) : STRIDE][: len(dx)]
                for k in range(EMBEDDED):
                    g["e"][:, k] += np.bincount(at, dx[: len(at), o, k], 256)
        n = float(weight.sum())
        return loss / n, {k: v / n for k, v in g.items()}

    def fit(self, texts: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, batch: int = 32, rate: float = 0.01, seed: int = 2) -> Network:
        """Adam on log loss; the rarer class counts more, up to threefold, and scores are then corrected for it."""
        rng, m, v, t = np.random.default_rng(seed), {}, {}, 0
        share = float(y.mean())
        extra = float(np.clip(share / (1 - share), 1 / 3, 3))
        weight = np.where(y == 0, extra, 1.0)
        # Few texts are gone through more often.
        epochs = min(5 * epochs, max(epochs, epochs * FIT_ROWS // (2 * len(texts))))
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                _, g = self.gradients([texts[i] for i in some], y[some], weight[some])
                t += 1
                for k, x in g.items():
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * x
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * x * x
                    step = rate * 0.01 ** (epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)
                    self.p[k] = (self.p[k] - step).astype(np.float32)
        self.p["b3"] = self.p["b3"] + np.float32(np.log(extra))
        return self


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, keep) -> list:
    """At most `rows` labelled learning rows, picked by a hash; keep(text) is what comes to the driver."""
    y = labels.select(F.col("doc_id").cast("long").alias("key"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & (fold(F.col("key")) != 0))
    picked = y.dropDuplicates(["key"]).orderBy(F.xxhash64("key"), "key").limit(rows)
    d = documents(docs)
    # The picked rows are bounded by the parameter, so they are broadcast.
    return d.join(F.broadcast(picked), d["doc_id"] == picked["key"]).select("key", keep(F.col("text")).alias("text"), "y").collect()


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> Network | float:
    """A network, or the share of label 1 where there is nothing to tell apart."""
    n = F.length("text")
    start = 1 + F.pmod(F.xxhash64("key"), F.greatest(F.lit(1), n - FIT_BYTES + 1)).cast("int")
    found = sorted(sample(docs, labels, label, rows, lambda text: F.substring(text, start, F.lit(FIT_BYTES))))
    y = np.array([r["y"] for r in found], float)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    return Network().fit([padded(r["text"]) for r in found], y)


def score(docs: DataFrame, model: Network | float, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for b in batches:
            z = [1 / (1 + np.exp(-np.clip(net.logit(t), -30, 30))) if isinstance(net, Network) else net for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(z, pa.float64())], ["doc_id", "held_out", "score"])

    rows = documents(docs).withColumn("held_out", fold(F.col("doc_id")) == 0)
    scored = rows.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
