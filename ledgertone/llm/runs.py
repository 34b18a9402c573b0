"""Periodic runs of words: stretches whose words repeat at a fixed distance, found at several scales.

A run's smallest period q is at most a quarter of its length. Periods up to SHORT are found by comparing the words
with themselves at each distance. Longer ones belong to the scale k, a power of two, with k / 2 < q <= k: of every
window of k / 2 neighbouring k-word strings the smallest hash is marked. Windows a period apart inside a run have the
same content, so marks repeat at distance q, and a k-word string occurs inside the run at multiples of q only; thus
marks with equal hashes that follow each other at a distance between k / 2 and k seed every run of the scale. Each
seed is extended word by word, exactly. Texts are laid end to end with marks of their own between them, so that one
pass serves many texts. The scales are given only zones whose SHORT-word strings are all there three times in their
text, which the words of a run are; work is in proportion to words, and to scales in those zones.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_text
from .jaccard import _mix

#: Words of a run and repetitions of its period, at least.
LEAST_WORDS, LEAST_REPEATS = 6, 4
#: Longest period that is looked for directly.
SHORT = 8
_FACTOR = 0x9E3779B97F4A7C15


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true values."""
    edges = np.flatnonzero(same[1:] != same[:-1]) + 1
    if len(same) and same[0]:
        edges = np.insert(edges, 0, 0)
    if len(same) and same[-1]:
        edges = np.append(edges, len(same))
    return edges[::2], edges[1::2]


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, from those of half as many."""
    wide = 1
    while wide < w:
        step = min(wide, w - wide)
        x, wide = np.minimum(x[:-step], x[step:]), wide + step
    return x


def _marked(x: np.ndarray, w: int) -> np.ndarray:
    """Places whose value is the smallest of some w neighbours, all of equal ones included."""
    if len(x) < w:
        return np.empty(0, np.int64)
    least = ~_window_min(x, w)
    # the largest of the window minima over a place is its own value just if it is the minimum of one of them
    padded = np.full(len(x) + w - 1, np.iinfo(x.dtype).max, x.dtype)
    padded[w - 1 : w - 1 + len(least)] = least
    return np.flatnonzero(~_window_min(padded, w) == x)


def _same_from(x: np.ndarray, i: int, q: int) -> int:
    """First place at or after i where the words q apart differ (or end)."""
    step = 64
    while i + q < len(x):
        to = min(i + step, len(x) - q)
        other = np.flatnonzero(x[i:to] != x[i + q : to + q])
        if len(other):
            return i + int(other[0])
        i, step = to, step * 2
    return i


def _same_before(x: np.ndarray, i: int, q: int) -> int:
    """Smallest place from which on up to i the words q apart are the same."""
    step = 64
    while i > 0:
        at = max(i - step, 0)
        other = np.flatnonzero(x[at:i] != x[at + q : i + q])
        if len(other):
            return at + int(other[-1]) + 1
        i, step = at, step * 2
    return i


def _smallest(x: np.ndarray, start: int, q: int) -> bool:
    """Whether a run of period q, which starts there, has no smaller one; a smaller one divides q."""
    rest, factor = q, 2
    while rest > 1:
        factor = factor if factor * factor <= rest else rest
        if rest % factor:
            factor += 1
            continue
        p = q // factor
        if np.array_equal(x[start : start + 2 * q - p], x[start + p : start + 2 * q]):
            return False
        while rest % factor == 0:
            rest //= factor
    return True


def _grown(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of 2 * k words out of those of k words."""
    return _mix(hashes[:-k] * np.uint64(_FACTOR) + hashes[k:])


def _zones(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x in zones of one place too many, and where they end: every long-period run is wholly in one of them.

    Each SHORT words in a row that such a run holds are there three times at least, as it has four periods. Words in a
    row are counted within their text, by buckets of hashes: too many may stay, none is lost.
    """
    salt = _mix(np.arange(len(starts), dtype=np.uint64))
    grams, k = x.view(np.uint64) * np.uint64(_FACTOR) + np.repeat(salt, np.diff(starts, append=len(x))), 1
    while k < SHORT:
        grams, k = grams[:-k] * np.uint64(pow(_FACTOR, k, 1 << 64)) + grams[k:], 2 * k
    bits = max(len(grams).bit_length(), 10)
    bucket = (grams >> np.uint64(64 - bits)).view(np.int64)
    a, b = _stretches(np.bincount(bucket, minlength=1 << bits)[bucket] >= LEAST_REPEATS - 1)
    long = b - a > LEAST_REPEATS * (SHORT + 1) - SHORT
    a, sizes = a[long], (b - a)[long] + SHORT  # SHORT - 1 words more than places, and the place after
    ends = np.cumsum(sizes)
    return np.arange(sizes.sum()) + np.repeat(a - ends + sizes, sizes), ends


def _long_runs(x: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of periods over SHORT; no zone has over ``longest`` words."""
    out, hashes, k = [], _mix(x.view(np.uint64)), 1
    # periods q with k / 2 < q <= k: the smallest has to fit into a zone
    while (k // 2 + 1) * LEAST_REPEATS <= longest:
        if k > SHORT:
            at = _marked(hashes, k // 2)
            order = np.argsort(hashes[at], kind="stable")
            place, value = at[order], hashes[at][order]
            gap = np.diff(place)
            good = (value[1:] == value[:-1]) & (gap > k // 2) & (gap <= k)
            seeds, gaps = place[:-1][good], gap[good]
            order = np.lexsort((seeds, gaps))
            end, last = 0, 0
            for i, q in zip(seeds[order].tolist(), gaps[order].tolist(), strict=True):
                if q == last and i < end:
                    continue  # within the stretch just looked at
                start, end, last = _same_before(x, i, q), _same_from(x, i, q), q
                if end - start >= (LEAST_REPEATS - 1) * q and _smallest(x, start, q):
                    out.append((start, end - start + q, q))
        if 2 * k > len(hashes):
            break
        hashes, k = _grown(hashes, k), 2 * k
    return out


def find_runs(x: np.ndarray, longest: int, starts: np.ndarray | None = None) -> np.ndarray:
    """(start, length, period) of all runs in a sequence of codes, by start and period; ``longest`` words in a text at most.

    Texts begin at ``starts``, the first of them at 0. Codes are 64-bit numbers, none of them from -2**32 to -1.
    """
    out, taken = [], set()
    for q in range(1, min(SHORT, longest // LEAST_REPEATS) + 1):
        a, b = _stretches(x[:-q] == x[q:])
        keep = b - a >= max(LEAST_WORDS, LEAST_REPEATS * q) - q
        for s, e in zip(a[keep].tolist(), (b[keep] + q).tolist(), strict=True):
            if (s, e) not in taken:  # as with a smaller period, which divides q
                taken.add((s, e))
                out.append((s, e - s, q))
    if longest >= LEAST_REPEATS * (SHORT + 1):
        places, ends = _zones(x, np.zeros(1, np.int64) if starts is None else starts)
        zones = np.append(x, 0)[places]
        zones[ends - 1] = -1 - np.arange(len(ends))
        found = _long_runs(zones, min(longest, int(np.diff(ends, prepend=0).max(initial=1)) - 1))
        out += [(int(places[s]), n, q) for s, n, q in found]
    return np.array(sorted(out, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


class _Words:
    """The words of some texts, none of them as an object of its own."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.data = np.frombuffer(b" ".join([b"", *raw, bytes(8)]), np.uint8)
        self.blank = (self.data[:-7] == 32) | (self.data[:-7] - np.uint8(9) < 5)  # those of BLANKS
        self.blank[-1] = True
        edges = np.flatnonzero(self.blank[1:] != self.blank[:-1]) + 1
        self.starts, self.ends = edges[::2], edges[1::2]
        #: Place of each text and of the end; number of each text's first word, and of all words.
        self.places = np.cumsum([1, *[len(r) + 1 for r in raw]])
        self.first = np.searchsorted(self.starts, self.places)

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """The words as numbers, each text followed by one that occurs nowhere else; starts of the texts.

        A word of eight bytes at most is a number by itself, with blanks behind it; that of a longer one begins with a
        blank, that of a text's end with a tab.
        """
        sizes, texts = np.minimum(self.ends - self.starts, 9), np.arange(len(self.places) - 1)
        eights = np.ndarray(len(self.data) - 7, "<u8", self.data, strides=(1,))
        x = eights[self.starts]
        own = np.array([(1 << 8 * n) - 1 for n in [*range(9), 0]], np.uint64)
        x = ((x & own[sizes]) | (~own & np.uint64(0x2020202020202020))[sizes]).astype(np.int64)
        long = np.flatnonzero(sizes == 9)
        if len(long):
            offsets = np.stack([self.starts[long], self.ends[long]], axis=1).ravel()
            cut = pa.Array.from_buffers(
                pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(self.data)]
            )
            known = cut.take(pa.array(np.arange(0, len(offsets), 2))).dictionary_encode()
            x[long] = known.indices.to_numpy().astype(np.int64) << 8 | 32
        return np.insert(x, self.first[1:], texts << 8 | 9), self.first[:-1] + texts

    def without(self, change: np.ndarray) -> pa.Array:
        """The texts of the words at which the running sum of ``change`` is 0, joined by blanks; each text's first is."""
        data, left = np.where(self.blank, np.uint8(32), self.data[:-7]), ~self.blank
        left[1:] |= left[:-1]  # a blank behind each word
        full = self.first[1:] > self.first[:-1]
        left[self.ends[self.first[1:][full] - 1]] = False  # but the last one of a text
        last = set(self.first[1:].tolist())
        for a, b in zip(*[e.tolist() for e in _stretches(np.cumsum(change[:-1]) > 0)], strict=True):
            left[self.starts[a] : self.ends[b - 1] + 1] = False
            if b in last:
                left[self.ends[a - 1]] = False
        places = self.places.tolist()
        sizes = [np.count_nonzero(left[a:b]) for a, b in zip(places[:-1], places[1:], strict=True)]
        offsets = np.cumsum([0, *sizes]).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data[left])])


_FIELDS = (
    "n_words long, n_runs long, start long, length long, period long, runs array<struct<start:long,length:long,period:long>>, "
    "runs_sha256 string, collapsed string"
)


def _rows(texts: list[str | None]) -> list[pa.Array]:
    words = _Words(texts)
    (x, starts), sizes = words.codes(), np.diff(words.first)
    found = find_runs(x, int(sizes.max(initial=0)), starts)
    of = np.searchsorted(starts, found[:, 0], side="right") - 1
    cuts = np.searchsorted(of, np.arange(len(texts) + 1)).tolist()
    change = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(change, found[:, 0] - of + found[:, 2], 1)
    np.add.at(change, found[:, 0] - of + found[:, 1], -1)
    found[:, 0] -= starts[of]
    best, listed, digests = [(None, None, None)] * len(texts), [[]] * len(texts), [hashlib.sha256().hexdigest()] * len(texts)
    for k in np.unique(of).tolist():
        runs = [tuple(r) for r in found[cuts[k] : cuts[k + 1]].tolist()]
        best[k] = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
        listed[k] = [{"start": s, "length": n, "period": p} for s, n, p in runs]
        digests[k] = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
    long = pa.int64()
    kind = pa.list_(pa.struct([("start", long), ("length", long), ("period", long)]))
    return [
        pa.array(sizes, long), pa.array(np.diff(cuts), long),
        *[pa.array([b[i] for b in best], long) for i in range(3)], pa.array(listed, kind), pa.array(digests), words.without(change),
    ]


def periodic_runs(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The rows, or their columns ``keep``, with the periodic runs of their whole texts and the text without the repetitions.

    A run is a stretch of words ``[^\\x20\\x09-\\x0D]+`` with smallest period q, of at least LEAST_WORDS words and
    LEAST_REPEATS * q, that neither neighbour extends. New columns: n_words, n_runs; start, length and period of the
    run with the greatest length / period (ties: smallest start, then period; null without runs); runs, by start and
    period; runs_sha256 of their lines ``start,length,period``; collapsed, the words that no run holds after its first
    q words, joined by blanks. Null and empty texts have no words and no runs. Every row stays, repeated ones too; an
    empty table gives an empty one; input columns of the new names are replaced. No shuffle.
    """
    return per_text(docs, text_col, _rows, _FIELDS, keep)
