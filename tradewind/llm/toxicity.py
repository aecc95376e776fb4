"""Toxicity by weak supervision.

Voters are words, word beginnings and patterns. The lexicon is mined from labelled rows of the learning folds:
tokens that toxic texts have far more often. A generative label model then takes the votes alone: by expectation
maximisation it estimates how often each voter fires in either class (its accuracy), and, from what correlation
is left within the classes, how much a voter repeats others, which lowers its weight. Its posterior labels train
a linear classifier on votes and hit counts; two numbers fitted on the labels bring the scores to scale.

Learning takes at most FIT_ROWS labelled rows, picked by a hash of their id; token counts are made by Spark, and
only the lexicon, bounded by LEXICON, and the sample's votes come to the driver. Scoring takes whole texts.

Defined results: null and empty texts have no votes and get the score of that; repeated rows are scored each;
without labels of both classes every score is the share of label 1 (or 0); other columns are left out; an empty
table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, fold, small_batches, written

FIT_ROWS, LEXICON = 10_000, 240
LEAST_DOCS, LEAST_ODDS = 4, 3.0
THRESHOLD = 0.5
PRIOR = 0.5
BEGINNINGS = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")
_LEET = re.compile(r"\b[^\W\d_]+(?:[013457@$]+[^\W\d_]+)+")
_PLAIN = str.maketrans("013457@$", "oieastas")
#: Fixed pattern voters: whom a text speaks to, threats, shouting, letters in disguise; and that no lexicon voter fires.
ADDRESSES = frozenset("you your du ihr tu toi vous eres ustedes".split())
THREATS = frozenset("kill hurt die hate".split())
_SHOUT = re.compile(r"[A-Z]{4,}!!")
PATTERNS = ("addresses", "threatens", "shouts", "disguises", "silent")
#: Words whose voters a worker keeps.
KEPT_WORDS = 400_000


def words(text: str) -> set[str]:
    """The distinct words in lower case, and what digits and signs inside words may stand for."""
    low = text.lower()
    return set(_WORD.findall(low)) | disguised(low)


def disguised(low: str) -> set[str]:
    if not any(c in low for c in "013457@$"):
        return set()
    return {w.translate(_PLAIN) for w in _LEET.findall(low)}


def tokens(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in BEGINNINGS if len(word) >= n)]


class _Known(dict):
    """The lexicon's voters by word."""

    def __init__(self, lexicon: dict[str, int]):
        self.lexicon = lexicon

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= KEPT_WORDS:
            self.clear()
        mine = self[word] = tuple(self.lexicon[t] for t in tokens(word) if t in self.lexicon)
        return mine


@dataclass
class Model:
    base: float
    lexicon: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray | None = None
    scale: tuple[float, float] = (1.0, 0.0)
    fire: np.ndarray | None = None
    discount: np.ndarray | None = None
    known: _Known | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "known": None}

    def votes(self, text: str) -> tuple[list[int], int]:
        """Voters that fire, and the number of distinct words that hit the lexicon."""
        if self.known is None:
            self.known = _Known(self.lexicon)
        low = text.lower()
        plain, odd = set(_WORD.findall(low)), disguised(low)
        found = [m for m in map(self.known.__getitem__, plain | odd) if m]
        fired = {i for m in found for i in m}
        n = len(self.lexicon)
        flags = (not plain.isdisjoint(ADDRESSES), not plain.isdisjoint(THREATS), "!!" in text and _SHOUT.search(text), any(self.known[w] for w in odd - plain), not found)
        fired.update(n + i for i, flag in enumerate(flags) if flag)
        return sorted(fired), len(found)

    def features(self, votes: Iterable[tuple[list[int], int]]) -> np.ndarray:
        votes = list(votes)
        x = np.zeros((len(votes), len(self.lexicon) + len(PATTERNS) + 2))
        for row, (fired, hits) in zip(x, votes, strict=True):
            row[fired] = 1
            row[-2:] = np.log1p(hits), 1
        return x

    def score(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.base)
        z = self.features(map(self.votes, texts)) @ self.weights
        return _sigmoid(self.scale[0] * z + self.scale[1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def label_model(v: np.ndarray, y: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors from votes (rows by voters), each voter's rate of firing by class, and its weight after correlations.

    A voter that doesn't fire abstains, so it says nothing; the last voter fires when all of the lexicon is silent.
    The labels give the classes' shares and the first guess of the rates, to which the rounds are tied by PRIOR of a
    class's mass; beyond that the rounds see the votes alone."""
    post = np.where(y == 1, 0.95, 0.05)
    odds = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    first = np.array([((1 - post) @ v + 0.5) / ((1 - post).sum() + 2), (post @ v + 0.5) / (post.sum() + 2)])
    weight = np.ones(v.shape[1])
    rates = np.empty((2, v.shape[1]))
    for n in range(rounds):
        mass = np.array([(1 - post).sum(), post.sum()])
        tied = PRIOR * mass
        rates[0] = ((1 - post) @ v + 0.5 + tied[0] * first[0]) / (mass[0] + 2 + tied[0])
        rates[1] = (post @ v + 0.5 + tied[1] * first[1]) / (mass[1] + 2 + tied[1])
        if n == 1:
            # What varies together within the classes says the same thing more than once.
            left = v - np.outer(1 - post, rates[0]) - np.outer(post, rates[1])
            spread = np.sqrt((left**2).mean(0)) + 1e-6
            corr = (left.T @ left) / len(v) / np.outer(spread, spread)
            np.fill_diagonal(corr, 0)
            weight = 1 / (1 + np.maximum(corr, 0).sum(0))
        z = odds + v @ (weight * np.log(rates[1] / rates[0]))
        post = _sigmoid(z)
    return post, rates, weight


def linear(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 12, weight: np.ndarray | float = 1.0) -> np.ndarray:
    """Logistic regression on soft labels, by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        g = x.T @ (weight * (target - p)) - penalty * w
        h = (x * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
    return w


def mined(rows: DataFrame, size: int = LEXICON) -> list[str]:
    """The lexicon: tokens of the labelled rows (key, y, text), by how much more toxic rows have them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted({t for w in words(text) for t in tokens(w)}) for text in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["y"], pa.array(found, pa.list_(pa.string()))], ["y", "tokens"])

    counts = rows.agg(F.sum("y"), F.count("*")).first()
    pos, neg = counts[0], counts[1] - counts[0]
    each = rows.select("y", "text").mapInArrow(run, "y int, tokens array<string>").select("y", F.explode("tokens").alias("t"))
    stats = each.groupBy("t").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")).filter(F.col("p") >= LEAST_DOCS)
    odds = F.ln((F.col("p") + 0.5) / (pos + 1.0)) - F.ln((F.col("n") + 0.5) / (neg + 1.0))
    best = stats.withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS).orderBy(F.desc(F.col("p") * F.col("odds")), "t").limit(size)
    return [r["t"] for r in best.collect()]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS) -> Model:
    small_batches(docs.sparkSession)
    y = labels.select(F.col("doc_id").cast("long").alias("key"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & (fold(F.col("key")) != 0))
    picked = y.dropDuplicates(["key"]).orderBy(F.xxhash64("key"), "key").limit(rows)
    d = documents(docs)
    # The picked rows are bounded by the parameter, so they are broadcast.
    sample = written(d.join(F.broadcast(picked), d["doc_id"] == picked["key"]).select("key", "y", "text"), "labelled")
    share = sample.agg(F.avg("y"), F.min("y"), F.max("y")).first()
    if share[0] is None or share[1] == share[2]:
        return Model(float(share[0] or 0.0))
    model = Model(float(share[0]), {t: i for i, t in enumerate(mined(sample))})

    def vote(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            votes = [model.votes(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["key"], b["y"], pa.array([v for v, _ in votes], pa.list_(pa.int32())), pa.array([h for _, h in votes], pa.int64())], ["key", "y", "fired", "hits"])

    found = sorted(sample.mapInArrow(vote, "key long, y int, fired array<int>, hits long").collect())
    truth = np.array([r["y"] for r in found], float)
    x = model.features((r["fired"], r["hits"]) for r in found)
    post, model.fire, model.discount = label_model(x[:, :-2], truth)
    model.weights = linear(x, post)
    z = x @ model.weights
    # Both classes count alike, so that a half lies between them.
    even = np.where(truth == 1, 0.5 / truth.mean(), 0.5 / (1 - truth.mean()))
    a, b = linear(np.c_[z, np.ones(len(z))], np.clip(truth, 0.01, 0.99), ridge=1e-3, weight=even)
    model.scale = (float(a), float(b))
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    scored = _scored(documents(docs).withColumn("held_out", fold(F.col("doc_id")) == 0), model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _scored(rows: DataFrame, model: Model, kept: list[str]) -> DataFrame:
    spark = rows.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = sent.value.score([t or "" for t in b["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(s, pa.float64())], [*kept, "score"])

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), "score double"])
    return rows.select(*dict.fromkeys([*kept, "text"])).mapInArrow(run, schema)


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns kept, that score under the threshold; null texts are scored as empty."""
    names = docs.columns
    held = docs.select(F.struct(*names).alias("doc"), "text")
    scored = _scored(held, model, ["doc"])
    return scored.filter(F.col("score") < threshold).select(*[F.col(f"doc.`{n}`").alias(n) for n in names])
