"""A quality classifier from positive and unlabelled text.

Positives are texts whose label says good; negatives are never needed, all text is unlabelled. The risk of a scorer
under the class prior is written with positives and unlabelled text only, and its part for the hidden negatives is kept
from falling below zero (non-negative risk), which keeps a flexible scorer from fitting noise. The prior is estimated
first: scorers of positives against unlabelled text are made, and the prior is the smallest ratio, over cuts that keep
enough of both, of the unlabelled share above the cut to the positive share above it.

Features: rates of pairs of character classes, and rates of repetition and length of words and lines, of whole texts,
made once and kept as a table. The scorer is linear on those and their hinge expansions (see expand()) with the squared
loss, so that both risks are quadratic and depend on the second moments of the expansions only: the fit reads every
positive and every unlabelled text outside the held-out fold, and nothing is sampled. Moments are summed in the tasks
and then in steps of FAN; to the driver come four matrices, two histograms and a sum, whatever the corpus holds.

Cases: a null text is the empty text, which gets a score like any other. A null id stays null, repeated rows give
repeated results (and count as often as they occur), other columns are not read. Without positives, or in an empty table,
every score is 0.5.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import crc_fold, in_slices, map_arrow, stored, text_of, word_hashes

THRESHOLD = 0.3

#: Classes of bytes: lower case, upper case, digit, blank, line end, sentence marks, other marks, symbols, quotes and
#: brackets, other controls, other letters.
_CLASS = np.full(256, 10, np.uint8)
for _k, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n", b".?", b",;:-'", b"#*$%&|<>=+~^_@\\/{}", b"\"()[]`", bytes(range(9)), b"", b"!")):
    _CLASS[list(_set)] = _k
N_CLASSES = 12
N_FEATURES = N_CLASSES * N_CLASSES + 10
#: How strongly weights are held to 0, and more of it for few positives.
RIDGE, RIDGE_FEW = 0.01, 1.0
#: Tables of sums that one task adds up, and rows that one table of sums is made of at least.
FAN, ROWS_A_SUM = 32, 500_000
#: Scores are counted in so many bins of -REACH to REACH.
BINS, REACH = 4096, 4.0


def _distinct(x: np.ndarray) -> float:
    return len(np.unique(x)) / len(x) if len(x) else 1.0


def features(text: str) -> np.ndarray:
    """The features of a whole text, each about 0 to 1."""
    data = text.encode("utf-8", "replace")
    out = np.zeros(N_FEATURES, np.float32)
    if not data:
        return out
    c = _CLASS[np.frombuffer(data, np.uint8)].astype(np.int64)
    if len(c) > 1:
        pairs = np.bincount(c[:-1] * N_CLASSES + c[1:], minlength=N_CLASSES * N_CLASSES)
        out[: N_CLASSES * N_CLASSES] = np.sqrt(pairs / (len(c) - 1))
    w = word_hashes(data)
    n = len(w)
    lines = data.split(b"\n")
    own = out[N_CLASSES * N_CLASSES :]
    own[0] = min(1.0, np.log1p(n) / 12)
    own[1] = 1 - _distinct(w)
    own[2] = 1 - _distinct(w[:-2] * np.uint64(3) + w[1:-1] * np.uint64(5) + w[2:] * np.uint64(7)) if n > 2 else 0
    own[3] = 1 - len(set(lines)) / len(lines)
    own[4] = min(1.0, len(data) / max(1, n) / 20)
    own[5] = min(1.0, len(lines) / max(1, n))
    own[6] = n < 50
    own[7] = n < 10
    own[8] = (w[1:] == w[:-1]).mean() if n > 1 else 0
    own[9] = np.sqrt(own[8])
    return out


def expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standard scores, bounded, and their parts beyond some deviations, so that a linear scorer can bend; a 1 at the end."""
    z = np.clip((x - mean) / scale, -6, 6) / 3
    return np.concatenate((z, np.maximum(z - 1 / 3, 0), np.maximum(z - 2.5 / 3, 0), np.maximum(-z - 1 / 3, 0), np.full((len(z), 1), 1 / 3)), axis=1)


def _histogram(scores: np.ndarray) -> np.ndarray:
    at = np.clip(((scores + REACH) * (BINS / (2 * REACH))).astype(np.int64), 0, BINS - 1)
    return np.bincount(at, minlength=BINS)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, slack: float = 0.1) -> float:
    """The share of positives among unlabelled scores, given both as counts by bin: the least ratio over cuts of the shares
    above the cut, with an allowance for chance that shrinks with the number of texts, 0.02 to 0.98."""
    n, m = positive.sum(), unlabelled.sum()
    p, u = np.cumsum(positive[::-1])[::-1] / n, np.cumsum(unlabelled[::-1])[::-1] / m
    enough = p >= 0.05
    chance = np.sqrt(np.log(4 / slack) / 2) * (1 / np.sqrt(n) + 1 / np.sqrt(m))
    best = int(np.argmin(np.where(enough, (u + chance) / np.maximum(p, 1e-9), np.inf)))
    return float(min(0.98, max(0.02, u[best] / p[best])))


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score_features(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), 0.5)
        return np.clip((1 + expand(x, self.mean, self.scale) @ self.weights) / 2, 0, 1)

    def score(self, texts: list[str]) -> np.ndarray:
        return self.score_features(np.stack([features(t) for t in texts]).astype(np.float64)) if texts else np.empty(0)


_UNKNOWN = QualityModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(0), 0.5)


def _contrast(positive: np.ndarray, unlabelled: np.ndarray, ridge: float) -> np.ndarray:
    """Weights that tell positives from unlabelled text, from the sums of both."""
    p, u = positive / (9 * positive[-1, -1]), unlabelled / (9 * unlabelled[-1, -1])  # the last column is 1 / 3
    return np.linalg.solve((p + u) / 2 + ridge * np.eye(len(p)), 3 * (p[-1] - u[-1]) / 2)


def fit_sums(positive: np.ndarray, unlabelled: np.ndarray, prior: float, ridge: float, rounds: int = 3000) -> np.ndarray:
    """Weights of least non-negative risk with the squared loss, from the sums of products of the expansions. Where the
    part of the hidden negatives is below zero, steps go up on it (as that risk is defined), else down on the whole."""
    p, u = positive / (9 * positive[-1, -1]), unlabelled / (9 * unlabelled[-1, -1])
    mp, mu = 3 * p[-1], 3 * u[-1]
    hidden = lambda w: ((1 + 2 * mu @ w + w @ u @ w) - prior * (1 + 2 * mp @ w + w @ p @ w)) / 4
    w = np.linalg.solve(u + ridge * np.eye(len(u)), 2 * prior * mp - mu)
    if hidden(w) >= 0:
        return w
    w = np.zeros(len(u))
    m, v = np.zeros(len(u)), np.zeros(len(u))
    for t in range(1, rounds + 1):  # Adam
        g = (u @ w + mu - 2 * prior * mp + ridge * w) / 2 if hidden(w) >= 0 else (prior * (mp + p @ w) - mu - u @ w) / 2
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


def _half(data: bytes) -> int:
    """Which of two halves a text's features are in: equal texts are in one."""
    return zlib.crc32(data) & 1


def _reduced(table: DataFrame, work, rows: int) -> dict[tuple[int, int], np.ndarray]:
    """Sums over a table of (kind, f): each task runs work on its batches of (kind, feature rows, halves), a dict of arrays
    that it adds to; those are added up in steps of FAN, and the last ones come to the driver by (kind, half)."""
    spark = table.sparkSession
    parts = table.rdd.getNumPartitions()
    tasks = max(1, min(parts, max(2 * spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_SUM))))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in in_slices(batches, 1000):
            data = batch.column(1).to_pylist()
            if not data:
                continue
            kinds, x = batch.column(0).to_numpy(zero_copy_only=False), np.frombuffer(b"".join(data), np.float32).reshape(-1, N_FEATURES).astype(np.float64)
            halves = np.array([_half(d) for d in data])
            for kind in np.unique(kinds).tolist():
                for half in (0, 1):
                    own = x[(kinds == kind) & (halves == half)]
                    if len(own):
                        made = work(kind, half, own)
                        sums[kind, half] = sums[kind, half] + made if (kind, half) in sums else made
        number = TaskContext.get().partitionId()
        rows = [(number, *key, value.tobytes()) for key, value in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, _SUM_TYPES, strict=True)], ["number", "kind", "half", "data"])

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        # in a fixed order, so that sums, and with them scores, don't change from run to run
        total = sum(np.frombuffer(d, np.float64) for d in group.sort_values("first")["data"])
        return pd.DataFrame([(key[0], key[1], key[2], total.tobytes())], columns=["number", "kind", "half", "data"])

    sums = map_arrow(table.coalesce(tasks), first, _SUMS)
    while tasks > 1:
        tasks = -(-tasks // FAN)
        sums = sums.withColumn("first", F.col("number")).groupBy((F.col("number") / FAN).cast("long").alias("number"), "kind", "half").applyInPandas(add, _SUMS)
    return {(r["kind"], r["half"]): np.frombuffer(bytes(r["data"]), np.float64) for r in sums.collect()}


_SUMS = "number long, kind int, half int, data binary"
_SUM_TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
POSITIVE, UNLABELLED = 1, 0


def _fitted(reduce) -> QualityModel:
    """The model, given reduce(work): the sums of work's arrays by (kind, half). Three passes over the features."""
    first = reduce(lambda kind, half, x: np.concatenate(([len(x)], x.sum(0), (x * x).sum(0))))
    both = [sum((first[kind, h] for h in (0, 1) if (kind, h) in first), np.zeros(1 + 2 * N_FEATURES)) for kind in (UNLABELLED, POSITIVE)]
    n = both[POSITIVE][0]
    if not n or not both[UNLABELLED][0]:
        return _UNKNOWN
    mean, square = both[POSITIVE][1 : 1 + N_FEATURES] / n, both[POSITIVE][1 + N_FEATURES :] / n
    scale = np.sqrt(np.maximum(square - mean * mean, 0)) + 0.01
    upper = np.triu_indices(4 * N_FEATURES + 1)

    def products(kind: int, half: int, x: np.ndarray) -> np.ndarray:
        e = expand(x, mean, scale)
        return (e.T @ e)[upper]

    def whole(flat: np.ndarray) -> np.ndarray:
        out = np.zeros((4 * N_FEATURES + 1,) * 2)
        out[upper] = flat
        return out + np.triu(out, 1).T

    sums = {k: whole(v) for k, v in reduce(products).items()}
    ridge = RIDGE + RIDGE_FEW / n
    total = [sum(sums[kind, h] for h in (0, 1) if (kind, h) in sums) for kind in (UNLABELLED, POSITIVE)]
    prior = 0.5
    if all((kind, h) in sums for kind in (UNLABELLED, POSITIVE) for h in (0, 1)):
        # the prior's scores come from scorers that haven't seen the texts
        other = [_contrast(sums[POSITIVE, 1 - h], sums[UNLABELLED, 1 - h], ridge) for h in (0, 1)]
        counts = reduce(lambda kind, half, x: _histogram(expand(x, mean, scale) @ other[half]).astype(np.float64))
        prior = class_prior(counts[POSITIVE, 0] + counts[POSITIVE, 1], counts[UNLABELLED, 0] + counts[UNLABELLED, 1])
    return QualityModel(mean, scale, fit_sums(total[POSITIVE], total[UNLABELLED], prior, ridge), prior)


def fit_features(pos: np.ndarray, unl: np.ndarray) -> QualityModel:
    """The model of the features of positives and of unlabelled texts, in memory."""
    halves = [np.array([_half(np.float32(row).tobytes()) for row in x], int) for x in (unl, pos)]

    def reduce(work) -> dict[tuple[int, int], np.ndarray]:
        return {(kind, h): work(kind, h, x[halves[kind] == h]) for kind, x in ((UNLABELLED, unl), (POSITIVE, pos)) for h in (0, 1) if (halves[kind] == h).any()}

    return _fitted(reduce)


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and f, the features of a whole text (N_FEATURES 32-bit numbers), kept as a table."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "f"])

    return stored(map_arrow(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, f binary"))


def fit(table: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, label_id_col: str = "doc_id", label_col: str = "quality") -> QualityModel:
    """The model of the rows of a feature table outside the held-out fold: positives are those with a label of 1, unlabelled
    text is all of them, whatever their label."""
    own = table.where(crc_fold("doc_id", folds) != held)
    good = labels.where(F.col(f"`{label_col}`") == 1).select(F.col(f"`{label_id_col}`").alias("doc_id")).distinct()
    positives = stored(own.join(good, "doc_id", "left_semi").select("f"))
    kinds = positives.select(F.lit(POSITIVE).alias("kind"), "f").union(own.select(F.lit(UNLABELLED).alias("kind"), "f"))
    rows = table.count()
    return _fitted(lambda work: _reduced(kinds, work, rows))


def score(table: DataFrame, model: QualityModel) -> DataFrame:
    """One row of a feature table: doc_id, score."""
    shared = table.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score_features(x), pa.float64())], ["doc_id", "score"])

    return map_arrow(table, run, f"doc_id {table.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """Fits outside the held-out fold and scores all rows: doc_id, held_out, score, predicted. Labels have the same id column."""
    table = feature_table(docs, id_col, text_col)
    out = score(table, fit(table, labels, folds, held, id_col, label_col))
    return out.select("doc_id", (crc_fold("doc_id", folds) == held).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
