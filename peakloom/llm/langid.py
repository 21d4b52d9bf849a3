"""Language identification with string kernels.

A text is the set of its character n-grams (n = 1 to 4, letters in lower case, runs of anything else as one blank):
the blended spectrum, as presence in DIM hashed places. The kernel of two texts is the cosine of those sets. Labelled
texts are mapped by Nyström's method onto LANDMARKS of them; one ridge regression a language, against the rest, is
fitted there. As the kernel is linear in the presence vector, landmarks and coefficients fold into one matrix with a
column a language, and a batch of texts is scored by one matrix product.

The fit reads a bounded sample of labelled rows: about PER_LANGUAGE texts of each language, chosen by a hash of the row,
whole texts. Tasks turn them into presence bits, 8 KB a text at most however long it is, which is what the driver gets.

Cases: a null text, or one without a letter, gets `und` with score 0, as does every text if no labelled row exists.
A null id stays null, repeated rows give repeated results, other columns are not read, an empty table gives an empty
result. Whole texts are used, however long. Ties go to the language first in order of code points.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import crc_fold, in_slices, map_arrow, text_of

DIM = 1 << 16
LONGEST = 4
PER_LANGUAGE = 500
#: Landmarks at least, and for each language where there are many.
LANDMARKS, LANDMARKS_EACH = 300, 75
RIDGE = 1e-3
#: Differences of regression values to probabilities.
SHARPNESS = 8.0

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)], bool))
    return _LETTER[0]


def places(text: str) -> np.ndarray:
    """The places of a text's n-grams, not sorted, some more than once; empty for a text without letters."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return np.empty(0, np.uint32)
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    c = np.where(letter, c, np.uint32(32))[keep]
    c = np.concatenate((np.array([32], np.uint32), c, np.array([32], np.uint32)))
    out, h = [], np.zeros(len(c) + 1, np.uint32)
    for n in range(1, LONGEST + 1):
        h = h[:-1] * np.uint32(0x01000193) + c[n - 1 :] + np.uint32(1)
        g = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
        out.append((g * np.uint32(0x297A2D39)) >> np.uint32(16))
    return np.concatenate(out)


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A batch's presence vectors, scaled to length 1 (all 0 without letters), and which texts have letters."""
    x = np.zeros((len(texts), DIM), np.float32)
    for row, text in zip(x, texts, strict=True):
        row[places(text)] = 1
    return _scaled(x)


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = x.sum(1, dtype=np.float64)
    x *= (1 / np.sqrt(np.maximum(size, 1)))[:, None].astype(np.float32)
    return x, size > 0


def packed(text: str) -> bytes:
    """A text's presence bits, compressed; empty without letters."""
    at = places(text)
    if not len(at):
        return b""
    bits = np.zeros(DIM, bool)
    bits[at] = True
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def _vectors(bits: list[bytes]) -> np.ndarray:
    """Scaled presence vectors of packed ones."""
    rows = np.frombuffer(b"".join(map(zlib.decompress, bits)), np.uint8).reshape(-1, DIM // 8)
    return _scaled(np.unpackbits(rows, axis=1).astype(np.float32))[0]


@dataclass
class LanguageModel:
    """languages: in order; weights: DIM x languages; offset: a value a language."""

    languages: list[str]
    weights: np.ndarray
    offset: np.ndarray

    def predict(self, texts: list[str], batch: int = 64) -> tuple[list[str], np.ndarray]:
        """The language and a score from 0 to 1 of each text."""
        names, scores = [], []
        for k in range(0, len(texts), batch):
            x, known = presence(texts[k : k + batch])
            if not self.languages:
                names += ["und"] * len(x)
                scores.append(np.zeros(len(x)))
                continue
            f = (x @ self.weights + self.offset).astype(np.float64)
            p = np.exp(SHARPNESS * (f - f.max(1, keepdims=True)))
            p /= p.sum(1, keepdims=True)
            best = f.argmax(1)
            names += [self.languages[b] if ok else "und" for b, ok in zip(best, known, strict=True)]
            scores.append(np.where(known, p[np.arange(len(p)), best], 0.0))
        return names, np.concatenate(scores) if scores else np.empty(0)


def fit_texts(texts: list[str], labels: list[str], landmarks: int | None = None, ridge: float = RIDGE, seed: int = 7) -> LanguageModel:
    """The model of labelled texts."""
    return fit_packed([packed(t) for t in texts], labels, landmarks, ridge, seed)


def _products(left: list[bytes], right: list[bytes], block: int = 256) -> np.ndarray:
    """Kernel values of packed texts, in blocks, so that few vectors are held at full width."""
    out = np.empty((len(left), len(right)), np.float64)
    for j in range(0, len(right), block):
        b = _vectors(right[j : j + block])
        for i in range(0, len(left), block):
            out[i : i + block, j : j + block] = _vectors(left[i : i + block]) @ b.T
    return out


def fit_packed(bits: list[bytes], labels: list[str], landmarks: int | None = None, ridge: float = RIDGE, seed: int = 7) -> LanguageModel:
    """The model of labelled texts' packed presence; landmarks, by default more with more languages, are dealt to the
    languages in turn."""
    pairs = [(b, y) for b, y in zip(bits, labels, strict=True) if b]
    languages = sorted({y for _, y in pairs})
    if not languages:
        return LanguageModel([], np.zeros((DIM, 0), np.float32), np.zeros(0, np.float32))
    landmarks = max(LANDMARKS, LANDMARKS_EACH * len(languages)) if landmarks is None else landmarks
    rng = np.random.default_rng(seed)
    own = {y: rng.permutation([i for i, p in enumerate(pairs) if p[1] == y]).tolist() for y in languages}
    chosen: list[int] = []
    while len(chosen) < min(landmarks, len(pairs)):
        for y in languages:
            if own[y] and len(chosen) < landmarks:
                chosen.append(own[y].pop())
    everything, marks = [b for b, _ in pairs], [pairs[i][0] for i in chosen]
    against = _products(everything, marks)
    values, vectors = np.linalg.eigh(against[chosen])
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # Nyström features of x: k(x, landmarks) @ root
    feats = against @ root
    y = np.array([[1.0 if p[1] == name else -1.0 for name in languages] for p in pairs])
    weight = _balance(pairs)
    mean_f, mean_y = weight @ feats, weight @ y
    a = (feats - mean_f) * np.sqrt(weight)[:, None]
    b = (y - mean_y) * np.sqrt(weight)[:, None]
    beta = np.linalg.solve(a.T @ a + ridge * np.eye(a.shape[1]), a.T @ b)
    folded = (root @ beta).astype(np.float32)
    weights = sum(_vectors(marks[k : k + 256]).T @ folded[k : k + 256] for k in range(0, len(marks), 256))
    return LanguageModel(languages, weights, (mean_y - mean_f @ beta).astype(np.float32))


def _balance(pairs: list[tuple[bytes, str]]) -> np.ndarray:
    """Weights that sum to 1, each language the same share."""
    names, inverse, count = np.unique([y for _, y in pairs], return_inverse=True, return_counts=True)
    return 1 / (len(names) * count[inverse])


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """The model of the rows where learn holds and neither text nor label is null. To the driver come one count a language
    and the presence bits of about per_language texts of each: a row is chosen by a hash of its id, text and place, so
    null and repeated ids are as good as others."""
    own = docs.select(learn.alias("learn"), F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").cast("string").alias("label"))
    rows = own.where("learn and label is not null and text is not null")
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    place = F.pmod(F.xxhash64("id", "text", F.monotonically_increasing_id(), F.lit("language")), F.lit(1 << 30))
    chosen = F.lit(False)
    for name, n in counts.items():
        chosen = chosen | ((F.col("label") == name) & (F.col("place") < int(min(1.0, per_language / n) * (1 << 30))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([packed(t) for t in batch.column(1).to_pylist()], pa.binary())], ["label", "bits"])

    sample = map_arrow(rows.withColumn("place", place).where(chosen).select("label", "text"), pack, "label string, bits binary").collect()
    made = sorted((r["label"], bytes(r["bits"])) for r in sample)
    return fit_packed([b for _, b in made], [y for y, _ in made])


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, lang_pred, score."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            names, scores = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """Fits on the rows outside the held-out fold and predicts all: doc_id, held_out, lang_pred, score."""
    fold = crc_fold(id_col, folds)
    model = fit(docs, fold != held, id_col, text_col, label_col)
    out = predict(docs, model, id_col, text_col)
    return out.select("doc_id", (crc_fold("doc_id", folds) == held).alias("held_out"), "lang_pred", "score")
