"""Toxicity: character n-gram vectors averaged over bags of words under a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (3 to 5 characters, with its borders), so a misspelling
shares most of its parts with the word it comes from. A bag is a run of ``BAG`` words, overlapping the next by half, and the
average over its places; a repeated word fills one place and places without a word count as zero. A text scores as its most toxic bag does: a few words of abuse count alike in a short and in a very long text.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text, sample_labelled

BAG = 16
SIZES = (3, 4, 5)
BUCKET_BITS = 18
DIM = 8
EDGES = ".,;:!?\"'()[]{}-_|"
#: Most labelled texts of each label that are learned from; the choice is by a hash of the id.
FIT_ROWS = 2500
#: Most characters of those texts in all, by the same order, so that the driver's share is bounded.
FIT_CHARS = 30_000_000


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, weights, word numbers in order) of all n-grams of all words; a word's weights sum to 1."""
    bare = [f"<{w.strip(EDGES) or w}>" for w in words]
    flat = np.frombuffer("".join(bare).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, bare), np.int64, len(bare))
    of, ends = np.repeat(np.arange(len(bare)), sizes), np.repeat(np.cumsum(sizes), sizes)
    buckets, home, key = [], [], np.zeros(len(flat), np.uint64)
    for n in range(1, max(SIZES) + 1):
        key = key[: len(flat) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + flat[n - 1 :] + np.uint64(n)
        if n in SIZES:
            fits = np.flatnonzero(np.arange(len(key)) + n <= ends[: len(key)])
            mixed = key[fits] * np.uint64(0xFF51AFD7ED558CCD)
            buckets.append((mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
            home.append(of[fits])
    home, buckets = np.concatenate(home or [of[:0]]), np.concatenate(buckets or [of[:0]])
    order = np.argsort(home, kind="stable")
    home, buckets = home[order], buckets[order]
    return buckets, (1.0 / np.bincount(home, minlength=len(bare)))[home] if len(home) else np.empty(0), home


#: Words whose n-grams are made at once.
WORDS_AT_ONCE = 10_000


class Parts:
    """The n-gram buckets of numbered words, in four bytes each."""

    def __init__(self, words: list[str]):
        made, counts = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for at in range(0, len(words), WORDS_AT_ONCE):
            some = words[at : at + WORDS_AT_ONCE]
            buckets, _, home = ngrams(some)
            made.append(buckets.astype(np.int32))
            counts.append(np.bincount(home, minlength=len(some)))
        self.buckets, self.count = np.concatenate(made), np.concatenate(counts)
        self.first = np.append(0, np.cumsum(self.count))

    def odds(self, lean: np.ndarray) -> np.ndarray:
        """What each word adds to the log odds: the mean over its n-grams."""
        out = np.zeros(len(self.count))
        for at in range(0, len(out), WORDS_AT_ONCE):
            count = self.count[at : at + WORDS_AT_ONCE]
            own = self.buckets[self.first[at] : self.first[at + len(count)]]
            home = np.repeat(np.arange(len(count)), count)
            out[at : at + len(count)] = np.bincount(home, lean[own] * (1.0 / np.maximum(count, 1))[home], minlength=len(count))
        return out


def bags_of(codes: np.ndarray, start: int) -> np.ndarray:
    """The distinct words of the bag that begins at start."""
    return np.unique(codes[start : start + BAG])


class Model:
    """Vectors of n-gram buckets, softmax weights and biases."""

    def __init__(self, seed: int = 7):
        self.rng = rng = np.random.default_rng(seed)
        # from zero, so that n-grams that were never learned say nothing; the random softmax weights break the symmetry
        self.vectors = np.zeros((1 << BUCKET_BITS, DIM), np.float32)
        self.seen = np.zeros(1 << BUCKET_BITS)
        self.slope, self.shift = 1.0, 0.0  # of the calibrated odds
        self.weights, self.bias = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)

    def flat(self) -> tuple[np.ndarray, float]:
        """What a bucket adds to the log odds, and the odds of an empty bag: all that scoring needs."""
        lean = self.weights[:, 1] - self.weights[:, 0]
        bias = float(self.bias[1] - self.bias[0])
        return (self.vectors @ (lean * self.slope)).astype(np.float32), bias * self.slope + self.shift


def word_odds(words: list[str], lean: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words))
    for at in range(0, len(words), WORDS_AT_ONCE):
        some = words[at : at + WORDS_AT_ONCE]
        buckets, weights, home = ngrams(some)
        out[at : at + len(some)] = np.bincount(home, lean[buckets] * weights, minlength=len(some))
    return out


def bag_odds(odds: np.ndarray, codes: np.ndarray, bias: float) -> np.ndarray:
    """Log odds of a text's bags, which begin at every half bag; a word counts once in a bag."""
    n, half = len(codes), BAG // 2
    if not n:
        return np.array([bias])
    order = np.argsort(codes, kind="stable")
    before = np.full(n, -1)
    same = codes[order][1:] == codes[order][:-1]
    before[order[1:][same]] = order[:-1][same]
    block = np.arange(n) // half * half
    cuts, value = np.arange(0, n, half), odds[codes]
    own = np.add.reduceat(value * (before < block), cuts)  # as part of the bag that begins with its half
    later = np.add.reduceat(value * (before < block - half), cuts)  # as part of the bag that ends with it
    bags = own[: max(1, len(cuts) - 1)]
    if len(cuts) > 1:
        bags = bags + later[1:]
    return bags / BAG + bias


def fit(texts: Iterable[str], labels: Iterable[int], seed: int = 7, rounds: int = 16, rate: float = 3.0) -> Model:
    """Train on texts with 0/1 labels; without both labels the model leans to the only one (or to 0)."""
    return fit_pairs(zip(texts, labels, strict=True), seed, rounds, rate)


def fit_pairs(pairs: Iterable[tuple[str, int]], seed: int = 7, rounds: int = 16, rate: float = 3.0) -> Model:
    """Train on (text, label) pairs, each turned into word numbers as it comes.

    The first rounds learn from random bags of every text under its text's label; later ones from each text's most
    toxic bag, so that the harmless part of a toxic text stops counting as toxic. Every fifth text is set aside to
    calibrate the odds of whole texts (all are used if that leaves fewer than 20 of a label).
    """
    model, rng = Model(seed), np.random.default_rng(seed)
    table: dict[str, int] = {}
    codes, labels = [], []
    for text, label in pairs:
        words = words_of(text)
        codes.append(np.fromiter((table.setdefault(w, len(table)) for w in words), np.int32, len(words)))
        labels.append(label)
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        model.bias = np.array([0, 4.0 if labels and labels[0] else -4.0], np.float32)
        model.vectors[:] = 0
        return model
    aside = np.zeros(len(y), bool)
    for label in (0, 1):
        aside[rng.permutation(np.flatnonzero(y == label))[::5]] = True
    if min((y[aside] == 0).sum(), (y[aside] == 1).sum()) < 20:
        aside[:] = False
    kept, check = np.flatnonzero(~aside), np.flatnonzero(aside) if aside.any() else np.arange(len(y))
    parts = Parts(list(table))
    del table
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for r in range(rounds):
        bags, of = [], []
        if r < 3:
            for i in kept:
                c = codes[i]
                for s in rng.integers(0, max(1, len(c) - BAG + 1), 8):
                    bags.append(bags_of(c, s))
                    of.append(i)
        else:
            lean, bias = model.flat()
            odds = parts.odds(lean)
            for i in kept:
                c = codes[i]
                bags.append(bags_of(c, int(np.argmax(bag_odds(odds, c, bias))) * (BAG // 2)))
                of.append(i)
                s = rng.integers(0, max(1, len(c) - BAG + 1))
                if not y[i]:
                    bags.append(bags_of(c, s))
                    of.append(i)
        order, of = rng.permutation(len(bags)), np.array(of)
        for part in np.array_split(order, max(1, len(order) // max(16, min(256, len(order) // 40)))):
            _step(model, [bags[k] for k in part], y[of[part]], share[of[part]], parts, rate * (1 - r / rounds))
    lean, bias = model.flat()
    odds = parts.odds(lean)
    model.slope, model.shift = calibrate(np.array([bag_odds(odds, codes[i], bias).max() for i in check]), y[check])
    return model


def calibrate(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve through (x, y), by Newton steps with a weak pull to slope 1."""
    a, b, pull = 1.0, 0.0, 0.5
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w, e = p * (1 - p) + 1e-9, p - y
        g = np.array([(e * x).sum() + pull * (a - 1), e.sum() + 0.01 * b])
        h = np.array([[(w * x * x).sum() + pull, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        da, db = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = max(0.05, a - da), b - db
    return float(a), float(b)


def _step(model: Model, bags, y, share, parts: Parts, rate: float) -> None:
    n = np.array([len(b) for b in bags])
    words = np.concatenate([*bags, np.empty(0, np.int64)]).astype(np.int64)
    bag = np.repeat(np.arange(len(bags)), n)
    count = parts.count[words]
    ends = np.cumsum(count)
    at = np.arange(int(count.sum())) - np.repeat(ends - count - parts.first[words], count)
    bag_of, idx, weights = np.repeat(bag, count), parts.buckets[at], np.repeat(1.0 / np.maximum(count, 1), count)
    # every step leaves out half of the n-grams, so that each part of a word learns to tell it, also misspelled
    w = (weights / BAG * 2 * (model.rng.random(len(at)) < 0.5)).astype(np.float32)
    rows = model.vectors[idx]
    mean = np.stack([np.bincount(bag_of, rows[:, d] * w, minlength=len(bags)) for d in range(DIM)], 1)
    logits = mean @ model.weights + model.bias
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    p *= share[:, None]
    back = (p @ model.weights.T).astype(np.float32)
    model.weights -= (0.2 * mean.T @ p / len(y)).astype(np.float32)
    model.bias -= (0.2 * p.mean(0)).astype(np.float32)
    # Adagrad: a bucket's steps shrink with the gradients it has seen, so rare n-grams learn as fast as common ones
    own, place = np.unique(idx, return_inverse=True)
    sums = np.stack([np.bincount(place, back[bag_of, d] * w, minlength=len(own)) for d in range(DIM)], 1)
    model.seen[own] += (sums * sums).sum(1)
    model.vectors[own] -= (rate * sums / np.sqrt(model.seen[own] + 1e-8)[:, None]).astype(np.float32)


def score_texts(texts: list[str | None], lean: np.ndarray, bias: float) -> np.ndarray:
    """The chance of label 1 for each whole text; a text without words has the model's chance for an empty bag."""
    table: dict[str, int] = {}
    codes = []
    for t in texts:
        words = words_of(t)
        codes.append(np.fromiter((table.setdefault(w, len(table)) for w in words), np.int64, len(words)))
    odds = word_odds(list(table), lean)
    top = np.array([bag_odds(odds, c, bias).max() for c in codes])
    return 1 / (1 + np.exp(-np.clip(top, -30, 30)))


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
           rows: int = FIT_ROWS) -> Model:
    """Fit on a bounded sample: at most ``rows`` documents of each label by a hash of the id, FIT_CHARS characters in all.

    Texts of over FIT_CHARS / 100 characters teach nothing.
    """
    return fit_pairs(sample_labelled(docs, labels, id_col, text_col, label_col, rows, FIT_CHARS))


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows with ``score`` (0 to 1, chance of label 1) and ``predicted``; columns of these names are replaced.

    Null and empty texts get the score of an empty bag. Rows are independent: ties, repeats and null ids are kept.
    """
    lean, bias = model.flat()
    shared = docs.sparkSession.sparkContext.broadcast((lean, bias))  # one number per bucket: 1 MB, whatever the input

    def run(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array(score_texts(texts, *shared.value))]

    return per_text(docs, text_col, run, "score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
