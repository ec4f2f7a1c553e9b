"""Toxicity by compression distance: two trained zstandard dictionaries, one of toxic and one of ordinary text.

A text is cut into windows (of one word with its surrounding spaces by default). Each window is compressed with
either dictionary; the bytes that the toxic dictionary saves over the ordinary one are the window's distance. A
fixed carrier after the window lets short windows match, as zstandard starts no match in a block's last bytes.
Both dictionaries are trained by zstandard on a bounded sample of labelled documents: the ordinary one on the windows
of ordinary documents; the toxic one on windows of toxic documents, in rounds. In a round each quarter of the
toxic documents keeps the windows whose distance, measured with a dictionary trained on the other quarters, is over a
quantile of the distances of ordinary windows; so what both kinds of text share, or one document alone has, is left out, and
the quantile rises from round to round. Counts of windows over each distance threshold and the longest distance are
calibrated to a probability on documents that the dictionaries were not trained on.

Defined cases: null and empty texts have no windows and get the score of a text without toxic windows; without
labels of both classes every score is 0; a null doc_id is scored and not held out; repeated rows get equal
scores, whatever rows they are scored with; a very long text is scored whole, by the counts of its windows (a task
holds its windows at once); an empty table gives an empty result; extra columns are kept by ``score``.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.llm.common import LOWER_AZ, bounded_batches, text_steps
from colophon.llm.labelled import PER_CLASS, class_counts, fit_logistic, held_out, sample

#: Words in a window. One word does best: in trials with one, two and three words models missed 2, 5 and 12 % of held-out toxic texts (0.1 GB of documents).
WINDOW = 1
#: Bytes of either dictionary, and ordinary windows that are trained on at most.
TOXIC_BYTES, ORDINARY_BYTES, ORDINARY_WINDOWS = 32_768, 110_000, 400_000
#: Distance thresholds whose windows are counted.
DISTANCES = (1, 2, 3, 4, 5, 6, 8)
THRESHOLD = 0.3
#: Rounds of training the toxic dictionary, parts of the toxic texts in a round, and the first and last quantile of ordinary distances that a window must exceed.
ROUNDS, PARTS, QUANTILES = 4, 4, (0.95, 0.995)
#: Bands of min-hashes, and hashes in a band, that tell near copies (0.8 alike or more).
BANDS, BAND_ROWS = 12, 6
#: One in so many documents of the sample calibrates; the dictionaries are trained on the others.
HELD = 4

_CARRIER = bytes(range(1, 25))
_PUNCTUATION = b'.,;:!?"()'
_MEMO = 300_000


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    words = (text or "").encode().translate(LOWER_AZ).translate(None, _PUNCTUATION).split()
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(0, len(words), size)]


def _compressor(dictionary: bytes):
    made = zstandard.ZstdCompressionDict(_CARRIER + dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters(window_log=18, chain_log=17, hash_log=17, search_log=6, min_match=4, target_length=64, strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)
    return zstandard.ZstdCompressor(dict_data=made, compression_params=how).compress


@dataclass
class Model:
    """Both dictionaries and the calibration; small enough to travel with the tasks (under 200 KB)."""

    toxic: bytes
    ordinary: bytes
    weights: np.ndarray | None
    size: int = WINDOW

    def distances(self):
        """A function from windows to distances; it remembers the windows that it met last."""
        toxic, ordinary, memo = _compressor(self.toxic), _compressor(self.ordinary), {}

        def of(found: list[bytes]) -> np.ndarray:
            out = np.empty(len(found), np.int64)
            for i, w in enumerate(found):
                d = memo.get(w)
                if d is None:
                    if len(memo) >= _MEMO:
                        memo.clear()
                    d = memo[w] = len(ordinary(w + _CARRIER)) - len(toxic(w + _CARRIER))
                out[i] = d
            return out

        return of


def features(distances: np.ndarray) -> list[float]:
    counts = [float((distances >= k).sum()) for k in DISTANCES]
    n = max(len(distances), 1)
    return [math.log1p(c) for c in counts] + [math.log1p(1000 * c / n) for c in counts] + [max(float(distances.max()), 0.0) / 4 if len(distances) else 0.0, float(distances.mean()) if len(distances) else 0.0]


def _one_of_each(texts: list[str], size: int) -> list[int]:
    """Positions of texts that are no near copy of an earlier one, by min-hashes in bands; copies would pass for evidence."""
    rng = np.random.default_rng(11)
    factor, shift = rng.integers(1, 2**31, (2, BANDS * BAND_ROWS), dtype=np.uint64) | np.uint64(1)
    seen, kept = set(), []
    for i, text in enumerate(texts):
        x = np.array([zlib.crc32(w) for w in set(windows(text, size))] or [0], np.uint64)
        least = ((x[:, None] * factor + shift) & np.uint64(0xFFFFFFFF)).min(axis=0)
        bands = {(b, *least[BAND_ROWS * b : BAND_ROWS * (b + 1)].tolist()) for b in range(BANDS)}
        if not bands & seen:
            kept.append(i)
            seen |= bands
    return kept


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A dictionary of at most ``size`` bytes; a smaller one, and in the end the samples themselves, where there is too little to train on."""
    while size >= 256:
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except (zstandard.ZstdError, ValueError):
            size //= 2
    return b"".join(samples)[-ORDINARY_BYTES:]


def _thinned(found: list[bytes], most: int) -> list[bytes]:
    return found[:: max(1, -(-len(found) // most))]


def dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]], rounds: int = ROUNDS) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary, trained on the windows of texts of either kind."""
    every = [w for text in ordinary for w in text]
    plain = _trained(ORDINARY_BYTES, _thinned(every, ORDINARY_WINDOWS))
    probe = _thinned(every, 40_000)
    parts = [[w for text in toxic[i::PARTS] for w in text] for i in range(PARTS)]
    kept = parts
    for r in range(rounds):
        quantile = QUANTILES[0] + (QUANTILES[1] - QUANTILES[0]) * r / max(rounds - 1, 1)
        new = []
        for i, part in enumerate(parts):
            others = [w for j, found in enumerate(kept) if j != i for w in found]
            of = Model(_trained(TOXIC_BYTES, others), plain, None).distances()
            bound = np.quantile(of(probe), quantile) if probe else 0
            new.append([w for w, d in zip(part, of(part).tolist()) if d > bound])
        if not all(new):
            break
        kept = new
    return _trained(TOXIC_BYTES, [w for found in kept for w in found]), plain


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, size: int = WINDOW) -> Model:
    """Fit on at most ``per_class`` documents of each class, near copies left out; without enough of both there is no model."""
    rows = sample(docs, labels, "toxic", per_class)
    kept = [i for y in (0, 1) for at in [np.flatnonzero(rows["label"] == y)] for i in at[_one_of_each(rows["text"].iloc[at].tolist(), size)].tolist()]
    found, toxic = [windows(t, size) for t in rows["text"].iloc[kept]], rows["label"].iloc[kept].to_numpy() == 1
    calibrate = np.zeros(len(found), bool)
    for y in (False, True):
        calibrate[toxic == y] = np.arange((toxic == y).sum()) % HELD == HELD - 1
    if min(toxic[calibrate].sum(), (~toxic[calibrate]).sum()) < 1:
        return Model(b"", b"", None, size)
    model = Model(*dictionaries([w for w, t, c in zip(found, toxic, calibrate) if t and not c], [w for w, t, c in zip(found, toxic, calibrate) if not t and not c]), None, size)
    # The dictionaries are not trained again on all: the longer ones would save more bytes than those that were calibrated.
    of = model.distances()
    x = np.array([features(of(found[i])) for i in np.flatnonzero(calibrate)])
    y = toxic[calibrate]
    model.weights = fit_logistic(x, y.astype(float))
    # The sample bounds either class; probabilities are those of the labels as they are.
    many = class_counts(labels, "toxic")
    model.weights[-1] += math.log(many[1] / many[0]) - math.log(y.sum() / (~y).sum())
    return model


def probability(distances: np.ndarray, weights: np.ndarray) -> float:
    """The calibrated probability of one text; a plain sum, so that it does not depend on the rows beside it."""
    total = math.fsum(x * w for x, w in zip([*features(distances), 1.0], weights.tolist()))
    return 1 / (1 + math.exp(-min(max(total, -30.0), 30.0)))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with held_out, score and predicted beside them (in place of columns so named)."""
    docs = docs.drop("held_out", "score", "predicted")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.distances()
        for part in text_steps(batches, "text"):
            p = [0.0 if model.weights is None else probability(of(windows(t, model.size)), model.weights) for t in part.column("text").to_pylist()]
            yield pa.record_batch([*part.columns, pa.array(p, pa.float64())], names=[*part.schema.names, "p"])

    bounded_batches(docs.sparkSession)
    # Plain names inside, so that extra columns cannot clash with ours.
    plain = docs.select(*[docs[c].alias("text" if c == "text" else f"d{i}") for i, c in enumerate(names)])
    schema = ", ".join(f"{c} {kind}" for c, kind in plain.dtypes)
    scored = plain.mapInArrow(run, schema + ", p double")
    back = [F.col("text" if c == "text" else f"d{i}").alias(c) for i, c in enumerate(names)]
    return scored.select(*back, held_out(F.col(f"d{names.index('doc_id')}")).alias("held_out"), F.col("p").alias("score"), (F.col("p") >= threshold).cast("int").alias("predicted"))
