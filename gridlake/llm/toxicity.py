"""Toxicity scoring with subword-bag embeddings and a linear softmax.

A text's passages are all its runs of a few words. A passage's vector is the mean of the embeddings of its character
n-grams, and a linear softmax over it gives clean against toxic; embeddings and softmax start at random and are trained
jointly by gradient descent in numpy. As only n-grams are embedded, a misspelling never seen shares most of its vectors
with the word it stands for. A text scores by its most toxic passage. Labels are per text: the first epochs let every
passage have its text's label, the later ones pick the most toxic passage of each text anew. A logistic fit calibrates
the score from the most toxic passage and the number of passages: among many clean ones some look toxic by chance. It is fitted on texts
that the model at hand hasn't learned from, and on long ones joined from them. Scoring reads whole texts in one pass, without a shuffle;
long ones part by part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridlake.llm.sampling import bounded_ids, texts_of
from gridlake.llm.text import LOWER, WHITE, chunks, join_texts, mix, pieces

BUCKETS = 1 << 17
GRAMS = (3, 5, 7)
_LETTER = mix(np.arange(7, 263, dtype=np.uint64))
#: ASCII bytes that aren't letters or digits count as a word's edge; other bytes are part of words.
_EDGE = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@dataclass
class Model:
    """weight: logit of each n-gram bucket (its embedding times the softmax's difference); the rest: offsets. ``drift`` is by how much the
    score's logit changes with the logarithm of the number of passages."""

    weight: np.ndarray
    bias: float
    slope: float
    shift: float
    window: int
    drift: float = 0.0

    def probability(self, most: np.ndarray, passages: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * most + self.shift + self.drift * np.log(np.maximum(passages, 1)), -30, 30)))


def subwords(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram buckets in order of word, number of each word's, row of each word)."""
    buffer, ends = join_texts(texts)
    folded = LOWER[buffer]
    white = WHITE[folded]
    start = ~white & np.concatenate([[True], white[:-1]])
    first = np.flatnonzero(start)
    row = np.searchsorted(ends, first, "right")
    if not len(first):
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word_of_byte = np.maximum(np.cumsum(start, dtype=np.int32) - 1, 0)
    edge = _EDGE[folded]
    # edges are one symbol, so that a word looks the same before a blank and before a full stop
    code = np.where(edge, np.uint64(0x51ED270B), _LETTER[folded])
    # position i stands for the n-gram of bytes i-1 .. i+n-2: grams may open and close with an edge
    padded = np.concatenate([[np.uint64(0x51ED270B)], code, np.full(max(GRAMS), 0x51ED270B, np.uint64)])
    letters = np.concatenate([[True], edge, np.ones(max(GRAMS), bool)])
    n, h = len(code), np.zeros(len(code), np.uint64)
    ids, owners = [], []
    broken = np.zeros(n, bool)  # an edge strictly inside
    for j in range(max(GRAMS)):
        h = h * np.uint64(0x9E3779B97F4A7C55) + padded[j : j + n]
        if j + 1 in GRAMS:
            at = np.flatnonzero(~broken & ~edge)
            ids.append((mix(h[at]) % np.uint64(BUCKETS)).astype(np.int32))
            owners.append(word_of_byte[at])
        if j:
            broken = broken | letters[j : j + n]
    ids, owners = np.concatenate(ids), np.concatenate(owners)
    return ids[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(first)), row


def passages(row: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, past the last word) of every run of ``window`` words of a row; a shorter row is one run."""
    n = len(row)
    first = np.arange(n)
    end = np.searchsorted(row, row, "right")
    opens = np.searchsorted(row, row, "left") == first
    use = (first + window <= end) | opens
    return first[use], np.minimum(first + window, end)[use]


def _logits(weight: np.ndarray, bias: float, ids: np.ndarray, count: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    by_word = np.concatenate([[0.0], np.cumsum(np.bincount(np.repeat(np.arange(len(count)), count), weights=weight[ids], minlength=len(count)))])
    grams = np.concatenate([[0], np.cumsum(count)])
    return (by_word[end] - by_word[first]) / np.maximum(grams[end] - grams[first], 1) + bias


def _text_max(logits: np.ndarray, row: np.ndarray, n: int, floor: float) -> np.ndarray:
    out = np.full(n, -np.inf)
    np.maximum.at(out, row, logits)
    return np.where(np.isfinite(out), out, floor)


def score_texts(model: Model, texts: list[bytes]) -> np.ndarray:
    """Probability that a text is toxic; a text without words scores as its lowest possible passage.

    Long texts are read part by part; a part begins with the last words of the one before, so no passage is missed."""
    most, many = np.full(len(texts), -np.inf), np.zeros(len(texts))
    before: tuple[int, bytes] = (-1, b"")
    for rows, parts in pieces(texts, WHITE, LOWER):
        tail = (rows[-1], b" ".join(parts[-1][-4096:].split()[-(model.window - 1) :]) if model.window > 1 else b"")
        if rows[0] == before[0]:
            parts[0] = before[1] + b" " + parts[0]
        before = tail
        ids, count, row = subwords(parts)
        if len(row):
            first, end = passages(row, model.window)
            of = np.asarray(rows)[row[first]]
            np.maximum.at(most, of, _logits(model.weight, model.bias, ids, count, first, end))
            many += np.bincount(of, minlength=len(texts))
    return model.probability(np.where(np.isfinite(most), most, model.bias - 8.0), many)


def _training_set(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram buckets, number of each word's, row of each word) of all texts, made a few texts at a time."""
    ids, counts, rows = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at, some in chunks(pa.array([t.encode() for t in texts], pa.binary()), 1 << 18):
        found, count, row = subwords(some)
        ids.append(found)
        counts.append(count)
        rows.append(row + at)
    return np.concatenate(ids), np.concatenate(counts), np.concatenate(rows)


#: Texts that are joined to a long one for the calibration, how many of each length, and what share of their weight has a toxic text among them.
JOINED, EACH, SHARE = (4, 16, 64), 200, 0.08


def fit(texts: list[str], labels: list[int], window: int = 2, seed: int = 7, **how: float) -> Model:
    """Train embeddings and softmax jointly on all texts, and the calibration on two halves, each with what was learned from the other.

    Without both labels every text gets the share of label 1."""
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99)
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))), window)
    weight, bias = learn(texts, y, window, seed=seed, **how)
    half = np.zeros(len(y), int)
    for label in (0, 1):  # every other text of each label
        half[np.flatnonzero(y == label)[1::2]] = 1
    seen = []
    for side in (0, 1):
        mine, others = np.flatnonzero(half == side), np.flatnonzero(half != side)
        whole = y[others].min() != y[others].max()  # else too few for halves: then those that were learned from have to do
        w, b = learn([texts[i] for i in others], y[others], window, seed=seed, **how) if whole else (weight, bias)
        seen.append((*_strongest(w, b, [texts[i] for i in mine], window), y[mine]))
    slope, shift, drift = _calibrated(seen, seed)
    return Model(weight.astype(np.float32), bias, slope, shift, window, drift)


def _strongest(weight: np.ndarray, bias: float, texts: list[str], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(logit of the most toxic passage, number of passages) of each text."""
    ids, count, word_row = _training_set(texts)
    first, end = passages(word_row, window)
    row = word_row[first]
    return _text_max(_logits(weight, bias, ids, count, first, end), row, len(texts), bias - 8.0), np.bincount(row, minlength=len(texts))


def _calibrated(seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]], seed: int) -> tuple[float, float, float]:
    """(slope, shift, drift) of a logistic fit to (most toxic logit, passages, label) of texts and of texts joined from them."""
    rng, rows = np.random.default_rng(seed), []
    for most, many, y in seen:
        rows.append(np.stack([most, many, y, np.ones(len(y))]))
        clean, toxic = np.flatnonzero(y == 0), np.flatnonzero(y == 1)
        for k in JOINED:
            for label in (0, 1):
                if not len(clean) or (label and not len(toxic)):
                    continue
                part = rng.choice(clean, (EACH, k))
                if label:
                    part[:, 0] = rng.choice(toxic, EACH)
                share = SHARE if label else 1 - SHARE
                rows.append(np.stack([most[part].max(1), many[part].sum(1), np.full(EACH, float(label)), np.full(EACH, share * len(y) / EACH)]))
    most, many, y, weight = np.concatenate(rows, axis=1)
    x = np.stack([most, np.log(np.maximum(many, 1))], axis=1)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, weight = np.zeros(3), weight / weight.sum()
    for _ in range(40):  # Newton steps; a little of the weights' square keeps separable labels finite
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - y)) + 0.001 * w
        w = w - np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 0.001 * np.eye(3), grad)
    slope, drift = w[:2] / scale
    return float(slope), float(w[2] - (w[:2] / scale * mean).sum()), float(min(drift, 0.0))


def learn(
    texts: list[str], labels: np.ndarray, window: int = 2, dim: int = 8, spread_epochs: int = 3, epochs: int = 6, rate: float = 0.5, batch: int = 2048, seed: int = 7
) -> tuple[np.ndarray, float]:
    """(logit of each n-gram bucket, bias): embeddings and softmax trained jointly. Both labels must occur."""
    y = np.asarray(labels, float)
    ids, count, word_row = _training_set(texts)
    first, end = passages(word_row, window)
    row = word_row[first]
    cut = np.concatenate([[0], np.cumsum(count)])
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.05, (BUCKETS, dim)).astype(np.float32)
    soft = rng.normal(0, 0.3, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    of_row = np.searchsorted(row, np.arange(len(y) + 1))

    def now() -> tuple[np.ndarray, float]:
        return (emb @ (soft[:, 1] - soft[:, 0])).astype(np.float64), float(bias[1] - bias[0])

    def epoch(use: np.ndarray, weight: np.ndarray, step: float) -> None:
        nonlocal emb, soft, bias
        for lo in range(0, len(use), batch):
            some = use[lo : lo + batch]
            begin, lens = cut[first[some]], cut[end[some]] - cut[first[some]]
            some, begin, lens, w = some[lens > 0], begin[lens > 0], lens[lens > 0], weight[lo : lo + batch][lens > 0]
            if not len(some):
                continue
            opens = np.concatenate([[0], np.cumsum(lens)[:-1]])
            g = ids[np.repeat(begin - opens, lens) + np.arange(lens.sum())]
            mean = np.add.reduceat(emb[g], opens) / lens[:, None]
            z = mean @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), y[row[some]].astype(int)] -= 1
            p *= w[:, None]
            back = np.repeat(((p @ soft.T) / lens[:, None]).astype(np.float32), lens, axis=0)
            for d in range(dim):
                emb[:, d] -= np.clip(step * np.bincount(g, weights=back[:, d], minlength=BUCKETS), -0.5, 0.5)
            soft -= step / len(some) * (mean.T @ p).astype(np.float32)
            bias -= step / len(some) * p.sum(0).astype(np.float32)

    per_row = np.diff(of_row)[row]
    for e in range(spread_epochs):  # every passage bears its text's label; texts and labels weigh alike
        use = rng.permutation(len(row))
        share = np.where(y[row] == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))) / per_row * len(row) / len(y)
        epoch(use, share[use], rate / (1 + e))
    for e in range(epochs):
        logits = _logits(*now(), ids, count, first, end)
        picked = []
        for r in range(len(y)):
            own = np.arange(of_row[r], of_row[r + 1])
            if len(own):
                top = own[np.argmax(logits[own])]
                picked += [top] if y[r] else [top, *rng.choice(own, min(3, len(own)), replace=False)]
        use = rng.permutation(np.array(picked, int))
        epoch(use, np.where(y[row[use]] == 1, 2.0, 1.0), rate * 4 / (1 + e))
    return now()


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 1200, max_chars: int = 8000) -> Model:
    """Fit on at most ``per_class`` labelled texts of each class, of at most ``max_chars`` each (documented bounds of the sample).

    Longer texts aren't learned from, as their heads alone may not bear out their label. Rows without doc_id, label or text are
    left out; of a repeated doc_id the smallest text counts. Without labels of both kinds every text scores the same."""
    ids = bounded_ids(labels, "doc_id", label, per_class)
    truth = {i: int(v) for v, found in ids.items() for i in found}
    texts = texts_of(documents, list(truth), max_chars=max_chars, whole=True)
    return fit(list(texts.values()), [truth[i] for i in texts])


def score(documents: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """All columns of documents plus ``score`` and ``predicted``; own columns of those names are replaced.

    Null and empty texts get the score of a text without any passage. Rows are never dropped; repeated rows score
    alike, and ties are no matter: each row has its own score. Texts of any length take some 30 MB of a worker. One pass of mapInArrow; the model (about 1 MB, a fixed number of buckets) travels as a broadcast.
    """
    keep = [c for c in documents.columns if c not in ("score", "predicted")]
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [score_texts(sent.value, texts) for _, texts in chunks(batch.column("text"))]
            s = np.concatenate(found) if found else np.zeros(0)
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    schema = documents.select(*keep).schema.add("score", "double").add("predicted", "integer")
    return documents.select(*keep).mapInArrow(run, schema)


def held_out(of: int, remainder: int) -> F.Column:
    """True for the fold that is kept from training: crc32 of doc_id as text modulo ``of`` is ``remainder``."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == remainder, F.lit(False))
