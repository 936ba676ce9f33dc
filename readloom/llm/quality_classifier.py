"""Quality by nearest-neighbour voting in a latent-semantic space.

The terms of a text are its hashed byte bigrams and trigrams and a few terms that say
how it is written: the shares of repeated words, symbols, capitals and digits and the lengths, in steps.
Weights are damped counts times inverse document frequency; both the frequencies and
the latent directions (a truncated singular value decomposition) are fitted on a bounded
sample of labelled texts, ``PER_CLASS`` of each label at most. How much the terms of
style weigh against the others is settled by a fixed rule in ``fit``: of ``WEIGHTS`` the one with the least
squared error, each class counting the same, over folds of the sample. The labelled vectors are
broadcast (their size follows from the sample's bound), and every text is held against
all of them: exact cosines, in blocks. The nearest ``NEIGHBOURS`` vote, weighted by
similarity.

Null and empty texts are scored like any other. Labels that contradict each other for
one id are averaged; of several texts with one id the smallest is learned from. Without
any label, or without a similar neighbour, the score is 0.5. Ids may be of any type.
Other columns are kept, but one with the score's name is replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm.common import sliced
from readloom.llm.words import IDENTITY, NOT_SPACE, split, sums

BUCKETS = 4_096
#: Labelled texts of each class: the bound of the sample and, with ``LATENT``, of what is broadcast (2000 x 64 floats).
PER_CLASS = 1_000
LATENT, NEIGHBOURS = 64, 15
#: Similarity is raised to this power to be a vote's weight.
SHARPNESS = 8
#: Terms for how a text is written: measures in steps, so many terms each.
STEPS = 8
_MEASURES = 7
_SLICE = 1 << 21
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>!")] = True
#: Style weights tried, rows they are tried on, and folds.
WEIGHTS = (0.15, 0.3, 0.6, 1.2, 2.4, 4.8, 9.6)
TRIED, FOLDS = 900, 3


def _n_grams(data: np.ndarray, n: int) -> np.ndarray:
    code = data[: len(data) - n + 1].astype(np.uint32)
    for k in range(1, n):
        code = (code << np.uint32(8)) | data[k : len(data) - n + 1 + k]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)


def features(column: pa.Array) -> np.ndarray:
    """(texts, BUCKETS + style terms) damped counts; the style terms come last."""
    w = split(column, NOT_SPACE, IDENTITY)
    n = len(w.bounds) - 1
    sizes = np.diff(w.row_bytes)
    counts = np.zeros((n, BUCKETS), np.float32)
    row = 0
    while row < n:  # whole rows together up to a bound of bytes; a longer one by itself, in slices
        upto, some = row, 0
        while upto < n and (upto == row or some + sizes[upto] <= _SLICE):
            some += sizes[upto]
            upto += 1
        lo, hi = int(w.row_bytes[row]), int(w.row_bytes[upto])
        for k in (2, 3):
            if upto == row + 1:
                for i in range(lo, hi - k + 1, _SLICE):
                    counts[row] += np.bincount(_n_grams(w.data[i : min(hi, i + _SLICE + k - 1)], k), minlength=BUCKETS)
            elif hi - lo >= k:
                of = np.repeat(np.arange(upto - row), sizes[row:upto])
                same = of[: hi - lo - k + 1] == of[k - 1 :]
                counts[row:upto] += np.bincount((of[: hi - lo - k + 1] * BUCKETS + _n_grams(w.data[lo:hi], k))[same], minlength=(upto - row) * BUCKETS).reshape(-1, BUCKETS)
        row = upto
    per_row = lambda flags: sums(flags, w.row_bytes)
    ids = w.words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    rows, words = w.rows, np.diff(w.bounds)
    distinct = np.bincount(np.unique(rows * (int(ids.max(initial=0)) + 1) + ids) // (int(ids.max(initial=0)) + 1), minlength=n)
    total = np.maximum(sizes, 1)
    symbol = _SYMBOLS[w.data]
    capital = (w.data >= 0x41) & (w.data <= 0x5A)
    digit = (w.data >= 0x30) & (w.data <= 0x39)
    again = np.zeros(len(ids), bool)
    again[1:] = (ids[1:] == ids[:-1]) & (rows[1:] == rows[:-1])
    shares = [
        sums(again, w.bounds) / np.maximum(words, 1),
        1 - distinct / np.maximum(words, 1) * np.minimum(1, np.sqrt(np.maximum(words, 1) / 100) + 0.5),
        np.minimum(1, per_row(symbol) / total * 8),
        np.minimum(1, per_row(capital) / total * 2),
        np.minimum(1, per_row(digit) / total * 8),
        np.minimum(1, np.log2(words + 1) / 16),
        np.minimum(1, (total / np.maximum(words, 1)) / 40),
    ]
    style = np.zeros((n, _MEASURES, STEPS), np.float32)
    steps = np.arange(STEPS) / (STEPS - 1)
    for m, share in enumerate(shares):  # a soft step: neighbouring steps share the weight
        style[:, m] = np.maximum(0, 1 - np.abs(np.clip(share, 0, 1)[:, None] - steps) * (STEPS - 1))
    return np.concatenate([np.log1p(counts), style.reshape(n, -1)], axis=1)


@dataclass
class Model:
    idf: np.ndarray
    weight: float  # of the style terms
    directions: np.ndarray  # (terms, latent)
    vectors: np.ndarray  # (labelled, latent), unit length
    labels: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        y = _weigh(x, self.idf, self.weight) @ self.directions
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray, block: int = 256) -> np.ndarray:
        out = np.full(len(x), 0.5)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        unit = self.project(x)
        for i in range(0, len(x), block):
            similar = unit[i : i + block] @ self.vectors.T
            near = np.argpartition(-similar, k - 1, axis=1)[:, :k]
            weights = np.maximum(np.take_along_axis(similar, near, axis=1), 0).astype(np.float64) ** SHARPNESS
            total = weights.sum(axis=1)
            out[i : i + block] = np.where(total > 0, (weights * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-300), 0.5)
        return np.clip(out, 0, 1)


def _weigh(x: np.ndarray, idf: np.ndarray, weight: float) -> np.ndarray:
    """Words and style are brought to fixed lengths, so that long texts do not drown the style terms."""
    words = x[:, :BUCKETS] * idf
    words /= np.maximum(np.linalg.norm(words, axis=1, keepdims=True), 1e-9)
    style = x[:, BUCKETS:] * (weight / np.sqrt(_MEASURES))
    return np.concatenate([words, style], axis=1).astype(np.float32)


def choose_weight(x: np.ndarray, labels: np.ndarray) -> float:
    """The weight of least squared error over folds of at most ``TRIED`` rows, each class counting the same."""
    rows = np.random.default_rng(5).permutation(len(x))[:TRIED]
    fold = np.arange(len(rows)) % FOLDS
    if min(np.bincount(labels[rows].astype(int), minlength=2)) < FOLDS:
        return WEIGHTS[len(WEIGHTS) // 2]

    def error(weight: float) -> float:
        wrong = np.zeros(len(rows))
        for k in range(FOLDS):
            model = fit(x[rows[fold != k]], labels[rows[fold != k]], weight)
            wrong[fold == k] = (model.score(x[rows[fold == k]]) - labels[rows[fold == k]]) ** 2
        return float(np.mean([wrong[labels[rows] == c].mean() for c in (0, 1)]))

    return min(WEIGHTS, key=error)


def fit(x: np.ndarray, labels: np.ndarray, weight: float | None = None) -> Model:
    if not len(labels):
        terms = BUCKETS + _MEASURES * STEPS
        return Model(np.ones(BUCKETS, np.float32), 1.0, np.zeros((terms, 1), np.float32), np.zeros((0, 1), np.float32), labels)
    weight = choose_weight(x, labels) if weight is None else weight
    idf = np.log((1 + len(x)) / (1 + (x[:, :BUCKETS] > 0).sum(axis=0))).astype(np.float32) + 1
    weighed = _weigh(x, idf, weight)
    values, vectors = np.linalg.eigh((weighed @ weighed.T).astype(np.float64))  # left singular vectors, smallest first
    top = np.argsort(-values)[: min(LATENT, len(x))]
    top = top[values[top] > 1e-9]
    directions = (weighed.T @ vectors[:, top] / np.sqrt(values[top])).astype(np.float32)
    model = Model(idf, weight, directions, np.zeros((0, len(top)), np.float32), labels.astype(np.float64))
    model.vectors = model.project(x)
    return model


def train(docs: DataFrame, labels: DataFrame, allowed: Column, per_class: int = PER_CLASS, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fits on at most ``per_class`` labelled rows of each label, chosen by a hash of the id, among ids that are ``allowed``."""
    marked = labels.where(F.col("quality").isNotNull() & F.col(doc_id).isNotNull() & allowed).groupBy(doc_id).agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    chosen = None
    for label in (0, 1):
        own = marked.where(F.col("quality") == label).orderBy(F.xxhash64(F.col(doc_id)), doc_id).limit(per_class)
        chosen = own if chosen is None else chosen.unionByName(own)
    # At most 2 * per_class ids: the bound that makes the broadcast safe. Repeated ids are combined before the shuffle.
    asked = F.broadcast(chosen.select(F.col(doc_id).alias("id"), F.col("quality").alias("label")))
    picked = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body")).join(asked, "id").groupBy("id").agg(F.min("body").alias("body"), F.first("label").alias("label"))
    shape = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("terms", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "body"):
            terms = pa.array([r.astype(np.float16).tobytes() for r in features(batch.column("body"))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("label").cast(pa.int32()), terms], shape.names)

    # The bounded sample is fitted in one task, so that the driver only ever holds the model (about 2 MB).
    def fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["terms"], r["label"]) for batch in batches for r in batch.to_pylist())
        x = np.zeros((len(rows), BUCKETS + _MEASURES * STEPS), np.float32)
        for i, (found, _) in enumerate(rows):
            x[i] = np.frombuffer(found, np.float16)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(x, np.array([label for _, label in rows], np.float64)))], pa.binary())], ["model"])

    fitted = picked.select("body", "label").mapInArrow(run, shape).repartition(1).mapInArrow(fit_all, "model binary").first()
    return pickle.loads(fitted["model"]) if fitted else fit(np.zeros((0, BUCKETS + _MEASURES * STEPS), np.float32), np.zeros(0))


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, to: str = "score") -> DataFrame:
    """``keep`` columns of ``docs`` and the score: 0 to 1, higher means label 1 is likelier."""
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c != to]
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(shared.value.score(features(batch.column(text))), pa.float64())], [*keep, to])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), T.StructField(to, T.DoubleType())]))
