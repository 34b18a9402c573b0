"""Quality by compression: one zstandard dictionary of good text and one of bad; the smaller output tells the kind.

A text is cut into chunks of ``CHUNK`` bytes, each compressed alone with either dictionary, so that a long text cannot
teach the compressor its own words and drown the difference. The size difference, normalised by the sizes, and the
compression with no dictionary at all pass through a logistic curve fitted on labelled texts kept out of the dictionaries.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text, sample_labelled

CHUNK = 1024
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
#: Most labelled texts of each label that are learned from, and most characters of them in all.
FIT_ROWS = 3000
FIT_CHARS = 40_000_000


def chunks(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    ends = [*range(CHUNK, len(raw) - CHUNK // 4, CHUNK), len(raw)]  # a short rest joins the chunk before it
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False) if b > a]


def dictionary(texts: Iterable[str]) -> bytes:
    """A trained dictionary; of too few samples, their last bytes as raw content."""
    samples = [c for t in texts for c in chunks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


class Sizes:
    """Compressed sizes of texts under the two dictionaries and under none."""

    def __init__(self, good: bytes, bad: bytes):
        self.squeeze = [self._compressor(good), self._compressor(bad), self._compressor(b"")]

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        plain = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
        if not content:
            return zstandard.ZstdCompressor(**plain)
        made = zstandard.ZstdCompressionDict(content)
        made.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=made, **plain)

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """Normalised difference over the whole text, the worst chunk's, how far the text compresses at all, and whether it is empty."""
        parts = chunks(text)
        if not parts:
            return 0.0, 0.0, 0.0, 1.0
        good, bad, none = (np.fromiter((len(c.compress(p)) for p in parts), float, len(parts)) for c in self.squeeze)
        size = sum(map(len, parts))
        # a chunk of few bytes says little by itself, so a fixed number of bytes joins its sizes
        worst = ((bad - good) / (bad + good + 64)).min()
        return (bad.sum() - good.sum()) / (bad.sum() + good.sum()), float(worst), none.sum() / size, 0.0


class Model:
    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray, bias: float):
        self.good, self.bad, self.weights, self.bias = good, bad, weights, bias

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.asarray(features, float).reshape(-1, 4) @ self.weights + self.bias, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, pull: float = 1e-2, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic curve by damped Newton steps; columns are scaled inside."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, keep = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], pull * len(x) / 10), 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(keep)
        step = np.linalg.solve(h, z.T @ (p - y) + keep * w)
        w -= step * min(1.0, 3.0 / (np.abs(step).max() + 1e-12))
    return w[:-1] / scale, float(w[-1] - (w[:-1] / scale * mean).sum())


def fit(texts: list[str], labels: list[int]) -> Model:
    """Every second text of a label makes its dictionary, the others fit the curve.

    Without both labels the score is a constant that leans to the one there is (0.5 without any).
    """
    by = {label: [t for t, y in zip(texts, labels, strict=True) if y == label] for label in (0, 1)}
    if not by[0] or not by[1]:
        return Model(b"", b"", np.zeros(4), 3.0 * (bool(by[1]) - bool(by[0])))
    made = {label: dictionary(own[::2]) for label, own in by.items()}
    sizes = Sizes(made[1], made[0])
    rest = [(t, label) for label, own in by.items() for t in (own[1::2] or own)]
    x = np.array([sizes.features(t) for t, _ in rest])
    return Model(made[1], made[0], *logistic(x, np.array([y for _, y in rest], float)))


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
           rows: int = FIT_ROWS) -> Model:
    """Fit on a bounded sample: at most ``rows`` documents of each label by a hash of the id, FIT_CHARS characters in all.

    Texts of over FIT_CHARS / 100 characters teach nothing.
    """
    got = list(sample_labelled(docs, labels, id_col, text_col, label_col, rows, FIT_CHARS))
    return fit([t for t, _ in got], [y for _, y in got])


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows with ``score`` (0 to 1, chance of label 1) and ``predicted``; columns of these names are replaced.

    Null and empty texts have one defined score, that of no difference. Rows are independent: ties, repeats and null
    ids are kept.
    """
    # two dictionaries of at most 64 KB each, whatever the input
    shared = docs.sparkSession.sparkContext.broadcast((model.good, model.bad, model.weights, model.bias))

    def run(texts: list[str | None]) -> list[pa.Array]:
        own = Model(*shared.value)
        sizes = Sizes(own.good, own.bad)
        return [pa.array(own.scores(np.array([sizes.features(t) for t in texts])))]

    return per_text(docs, text_col, run, "score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
