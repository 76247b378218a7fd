"""Quality classification by nearest neighbours among labelled latent-semantic vectors.

Terms of a text are its words and pairs of words, and, as an addition, runs of its shape (letters, capitals, digits and
punctuation, with runs of like letters drawn together) and marks of repeated words; all are hashed. Term counts are damped,
weighted by rarity and by how unlike the labels use them, and projected on the main singular directions of the labelled
sample. Each document is compared with every labelled vector (exact cosines, in blocks) and the most similar ones vote,
each with its similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridlake.llm.sampling import bounded_ids, texts_of
from gridlake.llm.text import NOT_ALNUM, SAME, WHITE, chunks, grams, join_texts, mix, words

#: Hashed columns: shapes and marks, words, pairs of words.
SHAPES, WORDS, PAIRS = 4096, 4096, 4096
TERMS = SHAPES + WORDS + PAIRS
_BLOCK = 1 << 18
#: Shape classes: 0 white space, 1 line break, 2 lower case or other letter, 3 capital, 4 digit; others stand for themselves.
_SHAPE = np.arange(256).clip(10, 245).astype(np.uint8)
_SHAPE[[9, 11, 12, 13, 32]] = 0
_SHAPE[10] = 1
_SHAPE[97:123] = 2
_SHAPE[128:] = 2
_SHAPE[65:91] = 3
_SHAPE[48:58] = 4


@dataclass
class Model:
    """weight and mean of terms, directions (TERMS x d), unit vectors of the sample, their labels, the share of label 1."""

    weight: np.ndarray
    mean: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    share: float
    neighbours: int


def terms(texts: list[bytes]) -> np.ndarray:
    """Dense matrix of damped term frequencies, one row a text. Long texts are read in blocks."""
    rows = len(texts)
    out = np.zeros(rows * TERMS, np.float32)

    def add(row: np.ndarray, column: np.ndarray, times: float = 1.0) -> None:
        for lo in range(0, len(row), _BLOCK):
            place, n = np.unique(row[lo : lo + _BLOCK] * TERMS + column[lo : lo + _BLOCK], return_counts=True)
            out[place] += times * n

    buffer, ends = join_texts(texts, 10)
    shape = _SHAPE[buffer]
    new = np.concatenate([[True], (shape[1:] != shape[:-1]) | (shape[1:] > 4)])
    new[ends[:-1]] = True
    at = np.flatnonzero(new)
    size = np.zeros(rows, np.float32)
    for lo in range(0, len(at), _BLOCK):
        some = at[lo : lo + _BLOCK + 4]
        code, row = shape[some].astype(np.uint64), np.searchsorted(ends, some, "right")
        size += np.bincount(row[:_BLOCK], minlength=rows)
        h = np.zeros(len(some), np.uint64)
        for n in range(1, 6):
            m = len(some) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint64(0x9E3779B97F4A7C55) + code[n - 1 :]
            whole = np.flatnonzero((row[:m] == row[n - 1 :])[:_BLOCK])
            add(row[whole], 16 + (mix(h[whole] + np.uint64(n)) % np.uint64(SHAPES - 16)).astype(np.int64))
    row, word = words(texts, WHITE, SAME)
    for gap in (1, 2, 3, 4):  # the same word again, a few words on
        again = np.flatnonzero((word[gap:] == word[:-gap]) & (row[gap:] == row[:-gap])) if len(word) > gap else np.zeros(0, int)
        add(row[again], np.full(len(again), gap), 3.0)
    order = np.lexsort((word, row))
    r, w = row[order], word[order]
    twice = np.flatnonzero((r[1:] == r[:-1]) & (w[1:] == w[:-1])) if len(w) > 1 else np.zeros(0, int)
    add(r[twice], np.full(len(twice), 5))
    row, word = words(texts, NOT_ALNUM)
    add(row, SHAPES + (word % np.uint64(WORDS)).astype(np.int64))
    first, pair = grams(row, word, 2)
    add(row[first], SHAPES + WORDS + (pair % np.uint64(PAIRS)).astype(np.int64))
    out = out.reshape(rows, TERMS)
    out /= np.maximum(size, 1)[:, None]
    return np.sqrt(out, out=out)


def project(model: Model, texts: list[bytes]) -> np.ndarray:
    x = (terms(texts) * model.weight - model.mean) @ model.directions
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def term_weights(seen0: np.ndarray, seen1: np.ndarray, n0: float, n1: float) -> np.ndarray:
    """Rarity of each term (by the texts of label 0 and of label 1 that have it), times how surely the labels differ in it."""
    share = (seen0 + seen1 + 1) / (n0 + n1 + 2)
    rarity = np.log(1 / share) + 0.2
    error = np.sqrt(share * (1 - share) * (1 / max(n0, 1) + 1 / max(n1, 1)))
    unlike = np.abs((seen1 + share) / (n1 + 1) - (seen0 + share) / (n0 + 1)) / np.maximum(error, 1e-6)
    return (rarity * (0.05 + np.clip(unlike - 2.5, 0, 8) / 8)).astype(np.float32)


def fit(texts: list[str], labels: list[int], dim: int = 48, neighbours: int = 15, seed: int = 11) -> Model:
    """Term weights and the randomised singular directions of the sample, and its vectors. No sample: all score 0.5."""
    y = np.asarray(labels, np.float32)
    if not len(y):
        return Model(np.ones(TERMS, np.float32), np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5, neighbours)
    x = np.zeros((len(texts), TERMS), np.float32)
    for lo in range(0, len(texts), 64):
        x[lo : lo + 64] = terms([t.encode() for t in texts[lo : lo + 64]])
    seen = [np.zeros(TERMS), np.zeros(TERMS)]
    for i, label in enumerate(y):
        seen[int(label)] += x[i] > 0
    weight = term_weights(seen[0], seen[1], len(y) - float(y.sum()), float(y.sum()))
    x *= weight
    mean = x.mean(0)
    x -= mean
    d = min(dim, len(x), TERMS)
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(x @ rng.normal(size=(TERMS, min(d + 10, len(x)))).astype(np.float32))
    for _ in range(3):
        q, _ = np.linalg.qr(x @ (x.T @ q))
    _, _, right = np.linalg.svd(q.T @ x, full_matrices=False)
    directions = np.ascontiguousarray(right[:d].T, np.float32)
    v = x @ directions
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return Model(weight, mean.astype(np.float32), directions, v.astype(np.float32), y, float(y.mean()), neighbours)


def score_texts(model: Model, texts: list[bytes], block: int = 256) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest labelled vectors."""
    out = np.full(len(texts), model.share)
    if not len(model.labels):
        return out
    k = min(model.neighbours, len(model.labels))
    for at in range(0, len(texts), block):
        cosine = project(model, texts[at : at + block]) @ model.vectors.T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-3)
        out[at : at + block] = (weight * model.labels[near]).sum(1) / weight.sum(1)
    return np.clip(out, 0.0, 1.0)


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1200) -> Model:
    """Fit on the heads (20,000 characters) of at most ``per_class`` labelled texts of each class (documented bounds of the sample).

    Rows without doc_id, label or text are left out; of a repeated doc_id the smallest text counts. Without any, all score 0.5."""
    ids = bounded_ids(labels, "doc_id", label, per_class)
    truth = {i: int(v) for v, found in ids.items() for i in found}
    texts = texts_of(documents, list(truth))
    return fit(list(texts.values()), [truth[i] for i in texts])


def score(documents: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """All columns of documents plus ``score`` (higher: label 1 likelier) and ``predicted`` (own ones are replaced).

    Null texts score as empty ones. Rows are never dropped; repeated rows score alike; other columns come through. Ties among
    neighbours are settled by the order of the sample. One pass of mapInArrow; the broadcast model is at most 2 * per_class vectors and
    a TERMS-row projection, about 3 MB whatever the corpus.
    """
    keep = [c for c in documents.columns if c not in ("score", "predicted")]
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [score_texts(sent.value, texts) for _, texts in chunks(batch.column("text"))]
            s = (np.concatenate(found) if found else np.zeros(0)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    schema = documents.select(*keep).schema.add("score", "double").add("predicted", "integer")
    return documents.select(*keep).mapInArrow(run, schema)
