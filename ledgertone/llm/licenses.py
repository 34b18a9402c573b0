"""Licence notices by conditional compression: a block that a template explains compresses far better after it.

Candidates are windows around cue words, of a size that the template bounds. Each is compressed alone and with every
template as raw zstandard dictionary. Windows are taken up in the order of the bytes saved, as long as a template saves a
share of its own size; only these are compared word by word, which gives the closest stretch that differs in no word that
tells licences apart. What differs is reported; if it is too much, or a notice was found, what lies left and right of the
stretch is compressed again by itself.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .license_texts import LONG, SHORT

#: A word that may belong to a notice. Every template holds at least one.
CUE = (
    r"(?i)licen[sc]|copyright|\bspdx\b|\bpermission\b|redistribut|\bwarrant|\bmozilla\b|creative commons|\bcc0\b|\bcc[ -]by|"
    r"public domain|unencumbered|free software"
)
#: Least share of a template's words that a notice keeps.
KEPT = 0.8
#: Least share of a template's bytes that it saves in compressing a window, for the window to be compared with it.
SAVED = 0.15
#: With an optimal parser, which the few bytes of a short notice need.
LEVEL = 19

#: Words that tell one licence from another.
TELLING = frozenset(
    "apache mit gnu general lesser affero mozilla bsd 3-clause 2-clause attribution sharealike noncommercial cc0 cc by by-sa by-nc "
    "1 2 3 4 1.0 2.0 2.1 3.0 4.0 v3.0 v2.0 neither unencumbered apache-2.0 gpl-3.0-only gpl-2.0-only mpl-2.0 bsd-3-clause "
    "bsd-2-clause attribution-sharealike attribution-noncommercial international isc and/or".split()
)
_WORD = re.compile(r"[^\s]+")


def bare(word: str) -> str:
    """A word without case and outer punctuation."""
    return word.lower().strip(".,;:()[]{}\"'`*#/<>!?|")


@lru_cache(maxsize=1)
def templates() -> list[tuple[str, str, list[str]]]:
    """(licence, text, bare words) of every template."""
    texts = [(name, t) for name, own in SHORT.items() for t in own] + list(LONG.items())
    return [(name, t, [bare(w) for w in t.split() if bare(w)]) for name, t in texts]


@lru_cache(maxsize=1)
def reach() -> int:
    """Words on either side of a cue that are searched: twice the longest template, which no notice exceeds."""
    return 2 * max(len(words) for _, _, words in templates())


@lru_cache(maxsize=1)
def _compressors() -> list[zstandard.ZstdCompressor]:
    """One without a dictionary, then one for each template."""
    made = [zstandard.ZstdCompressor(level=LEVEL)]
    for _, _, words in templates():
        raw = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=raw))
    return made


def blocks(text: str) -> list[tuple[int, int]]:
    """Stretches (start, end) in which notices may stand: the words in reach of each cue, joined."""
    cues = [m.start() for m in re.finditer(CUE, text)]
    if not cues:
        return []
    starts = np.array([m.start() for m in _WORD.finditer(text)])
    out: list[list[int]] = []
    for at in np.searchsorted(starts, cues, side="right") - 1:
        a, b = max(0, int(at) - reach()), min(len(starts), int(at) + reach())
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    ends = np.append(starts[1:], len(text))
    return [(int(starts[a]), int(ends[b - 1])) for a, b in out]


def saving(words: list[str], template: int) -> int:
    """Bytes that the template, as dictionary, saves in compressing the words."""
    raw = " ".join(words).encode("utf-8", "replace")
    alone, after = (len(_compressors()[k].compress(raw)) for k in (0, template + 1))
    return alone - after


def windows(cues: list[int], size: int, n: int) -> list[tuple[int, int]]:
    """Words (start, end) of n in reach of the cues: twice ``size`` on either side, cues within ``size`` together."""
    out, k = [], 0
    while k < len(cues):
        last = bisect(cues, cues[k] + size) - 1
        out.append((max(0, cues[k] - 2 * size), min(n, cues[last] + 2 * size + 1)))
        k = last + 1
    return out


def differences(want: list[str], have: list[str]) -> tuple[int, int, list[str], list[str]] | None:
    """(start, end, missing words, other words) of the stretch of ``have`` that comes closest to ``want``.

    By edit distance over words, with free ends in ``have``, among stretches that differ in no telling word (None if there
    is none); of equally close stretches the first. A word replaced is one missing and one other.
    """
    n, m = len(want), len(have)
    codes = {w: k for k, w in enumerate(dict.fromkeys(want + have))}
    b = np.array([codes[w] for w in have])
    never = 2 * (n + m) + 1  # more than all words together cost
    miss, skip = ([never if w in TELLING else 1 for w in words] for words in (want, have))
    steps = np.append(0, np.cumsum(skip))
    rows = [np.zeros(m + 1, np.int64)]
    for i, w in enumerate(want):
        best = rows[-1] + miss[i]  # a word of the template is missing
        same = b == codes[w]
        best[1:][same] = np.minimum(best[1:], rows[-1][:-1])[same]
        rows.append(np.minimum.accumulate(best - steps) + steps)  # then words of the text are left over
    j = end = int(rows[-1].argmin())
    if rows[-1][j] >= never:
        return None
    i, missing, other = n, [], []
    while i:
        here = rows[i][j]
        if j and want[i - 1] == have[j - 1] and here == rows[i - 1][j - 1]:
            i, j = i - 1, j - 1
        elif j and here == rows[i][j - 1] + skip[j - 1]:
            j -= 1
            other.append(have[j])
        else:
            i -= 1
            missing.append(want[i])
    return j, end, missing[::-1], other[::-1]


def _matches(have: list[str], cues: list[int]) -> list[tuple[int, int, int, int, list[str], list[str]]]:
    """(start, end, template, bytes saved, missing, other) of the notices among the words, which do not overlap."""
    taken: list[tuple[int, int]] = []
    out, heap, order = [], [], count()

    def rank(k: int, lo: int, hi: int) -> None:
        """Queue a window for comparison if the template saves enough bytes in it."""
        want = templates()[k][2]
        if hi - lo >= KEPT * len(want):  # else it is too short for a notice
            saved = saving(have[lo:hi], k)
            if saved >= SAVED * len(" ".join(want)):
                heapq.heappush(heap, (-saved, 1, next(order), k, lo, hi, None))

    for k, (_, _, want) in enumerate(templates()):
        for lo, hi in windows(cues, len(want), len(have)):
            rank(k, lo, hi)
    while heap:
        saved, _, _, k, lo, hi, differ = heapq.heappop(heap)
        i = max(0, bisect(taken, (lo, lo)) - 1)
        held = []
        while i < len(taken) and taken[i][0] < hi:
            held += [taken[i]] if taken[i][1] > lo else []
            i += 1
        if held:  # by what saves more: only the words around it are left
            for x, y in zip([lo] + [b for _, b in held], [a for a, _ in held] + [hi], strict=True):
                rank(k, x, y)
        elif differ:
            insort(taken, (lo, hi))
            out.append((lo, hi, k, -saved, *differ))
        else:
            want = templates()[k][2]
            most = len(want) - KEPT * len(want)
            closest = differences(want, have[lo:hi])
            if closest is None:
                continue
            (a, b), (missing, other) = (lo + x for x in closest[:2]), closest[2:]
            if len(missing) <= most and len(other) <= most:
                own = saving(have[a:b], k)  # a notice ranks by its own words
                heapq.heappush(heap, (-own, 0, next(order), k, a, b, (missing, other)))
            if len(missing) + len(other) <= 2 * most:  # else no stretch is close enough
                rank(k, lo, a)
                rank(k, b, hi)
    return sorted(out)


def notices(text: str | None) -> list[dict]:
    """The notices of a whole text in order, which do not overlap."""
    out = []
    for start, end in blocks(text) if text else []:
        block = text[start:end]
        places = [m.span() for m in _WORD.finditer(block) if bare(m[0])]  # comment marks are no words
        firsts = [a for a, _ in places]
        cues = sorted({max(0, bisect(firsts, m.start()) - 1) for m in re.finditer(CUE, block)})
        for a, b, k, saved, missing, other in _matches([bare(block[x:y]) for x, y in places], cues):
            out.append(
                {"license": templates()[k][0], "template": k, "start": start + places[a][0], "end": start + places[b - 1][1],
                 "bytes_saved": saved, "n_words": b - a, "n_different": len(missing) + len(other), "missing": missing, "other": other}
            )
    return out


_NOTICE = (
    "license string, template int, start int, end int, bytes_saved int, n_words int, n_different int, missing array<string>, "
    "other array<string>"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [(n, pa.list_(pa.string()) if "array" in t else pa.string() if t == "string" else pa.int32()) for n, t in (f.split() for f in _NOTICE.split(", "))]
    )
    for batch in batches:
        rows, of = [], []
        for i, text in enumerate(batch.column("text")):
            found = notices(text.as_py())
            rows += found
            of += [i] * len(found)
        made = pa.RecordBatch.from_pylist(rows, schema=schema)
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(of, pa.int64())), *made.columns], names=["id", *schema.names])


def find_notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per notice: id, license, template, start and end (characters), bytes_saved, n_words, n_different, missing, other.

    Whole texts are searched; texts without a cue are passed over before they reach Python. Every document stands for
    itself: null ids and repeated rows give their own rows; null, empty and clean texts give none. Where notices
    overlap, the one whose words its template saves most bytes of counts, of equals the one found first.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike(CUE))
    schema = T.StructType([rows.schema["id"], *T._parse_datatype_string(_NOTICE).fields])
    return rows.mapInArrow(_scan, schema).withColumnRenamed("id", id_col)
