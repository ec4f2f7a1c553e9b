"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer numpy network.

Every word and every word shape (kinds of characters, last character) has a fixed sparse ternary index vector,
found by hashing. A word's vector sums the index vectors of its neighbours over a bounded labelled sample, added
to its own; words not met there have their index vector alone. A document is the mean of its word vectors with a
few figures of the pooling itself (its norm, repeats of the word before, length). A network with one hidden
layer gives a probability, whose temperature is calibrated on documents that it did not learn from.

Defined cases: null and empty texts are pooled to zero and scored like that; without labels of both classes
every score is 0.5; a null doc_id is scored and not held out; repeated rows get equal scores, whatever
rows they are scored with; a very long text is pooled whole, in pieces of ``PIECE`` words; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.llm.common import STEP_BYTES, bounded_batches, hash_words, mix, own_columns, split_words, text_bytes, text_steps
from colophon.llm.labelled import PER_CLASS, held_out, sample

#: Rows of the vector table, dimensions, non-zero places of an index vector, neighbours on either side, hidden units.
ROWS, DIM, PLACES, REACH, HIDDEN = 1 << 14, 48, 6, 2, 24
THRESHOLD = 0.7
#: Words that are pooled at once.
PIECE = 1 << 17
_U = np.uint64

_CLASS = np.full(256, 16, np.uint8)  # other signs
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 4
_CLASS[128:] = 8


def index_vectors() -> np.ndarray:
    """The ternary index vectors of all rows."""
    out = np.zeros((ROWS, DIM), np.float32)
    for k in range(PLACES):
        h = mix(np.arange(ROWS, dtype=np.uint64) * _U(PLACES) + _U(k + 1))
        out[np.arange(ROWS), (h % _U(DIM)).astype(np.int64)] += np.where((h >> _U(40)) & _U(1), 1, -1)
    return out / np.sqrt(PLACES)


def _rows_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Table rows of words and of shapes, word hashes, and the first word of each document."""
    starts, ends, word_offs = split_words(data, offs)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), word_offs
    h = hash_words(data, starts, ends)
    bounds = np.stack([starts, ends], axis=1).ravel()
    kinds = np.bitwise_or.reduceat(np.append(_CLASS[data], 0), bounds)[::2]
    shape = kinds.astype(np.uint64) | (data[ends - 1].astype(np.uint64) << _U(8)) | (_U(1) << _U(20))
    return (h % _U(ROWS)).astype(np.int64), (mix(shape) % _U(ROWS)).astype(np.int64), h, word_offs


def _pool(table: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of features per document."""
    words, shapes, h, word_offs = _rows_of(data, offs)
    n = np.diff(word_offs).astype(np.float64)
    pooled = np.zeros((len(n), DIM))
    full = np.flatnonzero(n > 0)
    # Long texts are summed in pieces from their own start, the others together.
    for i in full[n[full] > PIECE].tolist():
        for a in range(word_offs[i], word_offs[i + 1], PIECE):
            b = min(a + PIECE, word_offs[i + 1])
            pooled[i] += table[words[a:b]].sum(axis=0, dtype=np.float64) + table[shapes[a:b]].sum(axis=0, dtype=np.float64)
    short = full[n[full] <= PIECE]
    for group in np.array_split(short, max(1, int(n[short].sum()) // PIECE)):
        if len(group):
            # Offsets inside the group's words; long texts between them make words of no document.
            at = np.concatenate([np.arange(word_offs[i], word_offs[i + 1]) for i in group])
            first = np.concatenate([[0], np.cumsum(n[group][:-1])]).astype(np.int64)
            for rows in (words, shapes):
                pooled[group] += np.add.reduceat(table[rows[at]], first, axis=0)
    pooled[full] /= n[full, None]
    same = np.zeros(len(h) + 1)
    same[1:-1] = h[1:] == h[:-1] if len(h) else same[1:-1]
    ends = np.concatenate([[0.0], np.cumsum(same[: len(h)])])
    repeats = (ends[word_offs[1:]] - ends[word_offs[:-1]]) / np.maximum(n, 1)
    norm = np.sqrt(_product(pooled**2, np.ones(DIM)))
    return np.column_stack([pooled, norm, repeats, np.log1p(n) / 8, np.log1p(np.diff(offs)) / 10])


def _features(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    return _pool(table, *text_bytes(texts))


def context_table(texts: list[str]) -> np.ndarray:
    """Word vectors: own index vector plus the mean of the neighbours', of unit length."""
    index = index_vectors()
    total, seen = np.zeros((ROWS, DIM), np.float32), np.zeros(ROWS, np.float32)

    def add(of: np.ndarray, neighbours: np.ndarray) -> None:
        if len(of):
            order = np.argsort(of, kind="stable")
            rows, first, count = np.unique(of[order], return_index=True, return_counts=True)
            total[rows] += np.add.reduceat(index[neighbours[order]], first, axis=0)
            seen[rows] += count

    for at in range(0, len(texts), 200):
        words, shapes, _, word_offs = _rows_of(*text_bytes(pa.array(texts[at : at + 200], pa.string())))
        row = np.repeat(np.arange(len(word_offs) - 1), np.diff(word_offs))
        for reach in range(1, REACH + 1):
            near = row[reach:] == row[:-reach]
            for tokens in (words, shapes):
                add(tokens[:-reach][near], tokens[reach:][near])
                add(tokens[reach:][near], tokens[:-reach][near])
    table = index + total / np.maximum(seen, 1)[:, None]
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _product(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w, summed in one fixed order for each row: a matrix product rounds by the rows that share its batch."""
    total = np.zeros(x.shape[:1] + w.shape[1:])
    for j in range(x.shape[1]):
        total += np.multiply.outer(x[:, j], w[j])
    return total


@dataclass
class Network:
    """Standardised input, tanh layer, logistic output and temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return _product(np.tanh(_product((x - self.mean) / self.scale, self.w1) + self.b1), self.w2) + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, epochs: int = 400, decay: float = 1e-3, seed: int = 5) -> Network:
    """Adam on the logistic loss, then the temperature on every fourth row, which was left out."""
    calibrate = np.arange(len(x)) % 4 == 3
    rng = np.random.default_rng(seed)
    net = Network(x.mean(axis=0), x.std(axis=0) + 1e-6, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), 0.0)
    z, t = (x[~calibrate] - net.mean) / net.scale, y[~calibrate]
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, epochs + 1):
        hidden = np.tanh(z @ params[0] + params[1])
        p = 1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3][0], -30, 30)))
        d = (p - t) / len(t)
        back = np.outer(d, params[2]) * (1 - hidden**2)
        grads = [z.T @ back + decay * params[0] / 10, back.sum(axis=0), hidden.T @ d + decay * params[2], np.array([d.sum()])]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            params[i] -= 0.02 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    logits, held = net.logits(x[calibrate]), y[calibrate]
    choices = np.geomspace(0.25, 8, 60)
    losses = [np.mean(np.logaddexp(0, np.where(held == 1, -logits, logits) / c)) for c in choices] if len(held) else [0.0]
    net.temperature = float(choices[int(np.argmin(losses))]) if len(held) else 1.0
    return net


@dataclass
class Model:
    """Vector table (3 MB) and network; None without labels of both classes."""

    table: np.ndarray | None
    network: Network | None


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on at most ``per_class`` documents of each class."""
    rows = sample(docs, labels, "quality", per_class)
    if rows["label"].nunique() < 2:
        return Model(None, None)
    texts = rows["text"].tolist()
    table = context_table(texts)
    x = np.vstack([_features(pa.array(texts[i : i + 200], pa.string()), table) for i in range(0, len(texts), 200)])
    return Model(table, fit_network(x, rows["label"].to_numpy(float)))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_steps(batches, "text", STEP_BYTES // 2):
            p = model.network.probabilities(_features(part.column("text"), model.table)) if model.network else np.full(part.num_rows, 0.5)
            yield pa.record_batch([part.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    bounded_batches(docs.sparkSession)
    scored = own_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
