"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages that cover its whole text. Every passage is encoded from its own bytes alone: the
shares of byte classes, how long its words are, and how its words and runs of three repeat. A small network maps each
encoding to a hidden vector, gated attention weighs the passages of a document, and a logistic layer scores
the weighted sum, so nothing about a document reaches its score past the attention. All weights, those of the attention included, are learned from document labels.

Passages have 512 bytes, whatever the length of the text, in fitting and in scoring. Fitting uses at most
``sample_docs`` labelled documents, chosen by hash of their id, and of each at most 64 passages, drawn at random
with a hash of the text as seed; this bounds what reaches the driver. Scoring reads all passages of every document once and
shuffles nothing; its memory grows with the longest document, of which a task holds some hundred bytes of work arrays for
each byte.

Defined results: null and empty texts are one empty passage and get a score; without usable labels every
score is 0.5, and with labels of one class only it is that class's smoothed share; of repeated ids in the
labels the largest label counts, in the sample the smallest text; repeated rows are scored each; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, unused

#: The second bounds what fitting collects of a document, not what is scored.
PASSAGE_BYTES, MOST_PASSAGES = 512, 64
#: Bytes below 128 are classes of their own; all others are one.
CLASSES = np.minimum(np.arange(256), 128).astype(np.int64)
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: A fixed random value for each byte; the sum over a word stands for the word.
VALUES = np.random.default_rng(20).integers(1, 2**62, 256, dtype=np.int64)
WIDTH = 129 + 7


def _repeats(group: np.ndarray, value: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each group: how many values there are, and how many distinct ones."""
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    first = np.ones(len(g), dtype=bool)
    first[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    return np.bincount(group, minlength=groups), np.bincount(g[first], minlength=groups)


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Encodings of all passages, and the number of passages of each text."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(x) for x in raw], dtype=np.int64)
    counts = np.maximum(1, -(-sizes // PASSAGE_BYTES))
    first = np.concatenate([[0], np.cumsum(counts)])
    total = int(first[-1])
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    doc = np.repeat(np.arange(len(raw)), sizes)
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    passage = first[doc] + (np.arange(len(data)) - begin[doc]) // PASSAGE_BYTES
    length = np.bincount(passage, minlength=total).astype(np.float64)
    shares = np.bincount(passage * 129 + CLASSES[data], minlength=total * 129).reshape(total, 129) / np.maximum(length, 1)[:, None]

    space = SPACE[data]
    start = ~space
    start[1:] &= space[:-1] | (doc[1:] != doc[:-1])
    at = np.flatnonzero(start)
    own = passage[at]
    out = np.zeros((total, WIDTH))
    out[:, :129] = np.sqrt(shares)
    # a text is encoded alike whatever stands beside it, also if no text here has a word
    word = np.add.reduceat(np.where(space, 0, VALUES[data]), at) if len(at) else np.zeros(0, np.int64)
    n = np.maximum(np.bincount(own, minlength=total), 1)
    for k in (1, 2):  # words that equal the one before, or the one before that
        same = np.zeros(len(at), dtype=bool)
        same[k:] = (word[k:] == word[:-k]) & (doc[at[k:]] == doc[at[:-k]])
        out[:, 128 + k] = np.bincount(own[same], minlength=total) / n
    words, kinds = _repeats(own, word, total)
    out[:, 131] = kinds / np.maximum(words, 1)
    out[:, 132] = words / 100
    out[:, 133] = length / n / 10
    three = word.copy()
    three[2:] = word[2:] * 3 + word[1:-1] * 5 + word[:-2] * 7
    words, kinds = _repeats(own, three, total)
    out[:, 134] = kinds / np.maximum(words, 1)
    out[:, 135] = length == 0
    return out.astype(np.float32), counts


class Model(NamedTuple):
    """Network weights; ``constant`` stands for all of them where there was nothing to learn from."""

    constant: float | None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: dict | None = None

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(counts), self.constant)
        logit = _forward(self.weights, (x - self.mean) / self.scale, counts)[0]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _forward(w: dict, x: np.ndarray, counts: np.ndarray) -> tuple:
    begin = np.concatenate([[0], np.cumsum(counts)])[:-1]
    h = np.tanh(x @ w["W"] + w["b"])
    t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    e = (t * s) @ w["a"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, begin), counts))
    a = e / np.repeat(np.add.reduceat(e, begin), counts)
    z = np.add.reduceat(a[:, None] * h, begin, axis=0)
    return z @ w["c"] + w["d"], h, t, s, a, z


def _gradient(w: dict, x: np.ndarray, counts: np.ndarray, y: np.ndarray, decay: float) -> dict:
    logit, h, t, s, a, z = _forward(w, x, counts)
    begin = np.concatenate([[0], np.cumsum(counts)])[:-1]
    dl = (1 / (1 + np.exp(-logit)) - y) / len(y)
    dz = np.repeat(dl[:, None] * w["c"], counts, axis=0)
    da = (dz * h).sum(1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, begin), counts))
    dt, ds = de[:, None] * w["a"] * s * (1 - t * t), de[:, None] * w["a"] * t * s * (1 - s)
    dh = (a[:, None] * dz + dt @ w["V"].T + ds @ w["U"].T) * (1 - h * h)
    g = {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "a": (t * s).T @ de, "c": z.T @ dl, "d": dl.sum(keepdims=True)}
    return {k: v + decay * w[k] * (k in "WVUc") for k, v in g.items()}


def fit(x: np.ndarray, counts: np.ndarray, y: np.ndarray, hidden: int = 48, attention: int = 24, epochs: int = 30, batch: int = 128, rate: float = 3e-3, decay: float = 1e-5, seed: int = 7) -> Model:
    if len(y) == 0:
        return Model(0.5)
    if y.min() == y.max():
        return Model(float((y.sum() + 1) / (len(y) + 2)))
    mean, scale = x.mean(0), x.std(0) + 0.01
    x = (x - mean) / scale
    rng = np.random.default_rng(seed)
    init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    w = {"W": init(x.shape[1], hidden), "b": np.zeros(hidden, np.float32), "V": init(hidden, attention), "U": init(hidden, attention), "a": init(attention), "c": init(hidden), "d": np.zeros(1, np.float32)}
    m, v = ({k: np.zeros_like(p) for k, p in w.items()} for _ in range(2))
    first = np.concatenate([[0], np.cumsum(counts)])
    step, steps = 0, epochs * -(-len(y) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            docs = order[lo : lo + batch]
            rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
            g = _gradient(w, x[rows], counts[docs], y[docs].astype(np.float32), decay)
            step += 1
            now = rate * (1 - step / (steps + 1))
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                w[k] = (w[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(None, mean, scale, w)


def _slices(texts: pd.Series, most_bytes: int = 1_000_000) -> Iterator[list[str]]:
    """Consecutive runs of texts of about ``most_bytes`` each, so work arrays stay small."""
    run: list[str] = []
    size = 0
    for t in texts:
        t = t or ""
        if run and size + len(t) > most_bytes:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def sampled(passages: np.ndarray, seed: int) -> np.ndarray:
    """At most MOST_PASSAGES of a document's passages, in their order."""
    if len(passages) <= MOST_PASSAGES:
        return passages
    return passages[np.sort(np.random.default_rng(seed & (2**63 - 1)).choice(len(passages), MOST_PASSAGES, replace=False))]


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_docs: int = 4096) -> Model:
    """Fit on a sample of ``labels`` (doc_id and ``label``) that holds at most ``sample_docs`` documents."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    bags = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = 0
            for run in _slices(batch["text"]):
                x, counts = encode(run)
                ids = batch["doc_id"].iloc[done : done + len(run)].to_numpy()
                parts = [sampled(p, zlib.crc32(t.encode("utf-8", "replace"))) for p, t in zip(np.split(x, np.cumsum(counts)[:-1]), run)]
                yield pd.DataFrame({"doc_id": ids, "y": batch["y"].iloc[done : done + len(run)].to_numpy(), "x": [p.tobytes() for p in parts]})
                done += len(run)

    rows = sorted(bags.mapInPandas(encoded, "doc_id long, y int, x binary").collect(), key=lambda r: r["doc_id"])
    parts = [np.frombuffer(r["x"], dtype=np.float32).reshape(-1, WIDTH) for r in rows]
    x = np.concatenate(parts) if parts else np.zeros((0, WIDTH), np.float32)
    return fit(x, np.array([len(p) for p in parts], dtype=np.int64), np.array([float(r["y"] > 0) for r in rows]))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability of the higher label to every row."""

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(np.concatenate([model.score(*encode(run)) for run in _slices(texts)]) if len(texts) else np.zeros(0))

    return docs.withColumn(out, scored(F.col(text)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drop documents that score under 0.5. Empty and null texts are scored too, repeated rows each, and
    columns are kept as they are, also one called score; without labels nothing is dropped."""
    model = learn(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    name = unused(docs.columns, "score")
    return score(docs, model, out=name).where(F.col(name) >= 0.5).drop(name)


QUERIES = {"op2_quality": op2_quality}
ORACLES: dict[str, str] = {}
