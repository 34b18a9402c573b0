"""Byte strings that documents share with smaller ones, by suffix arrays over dealt pieces.

Whether a window of ``least`` bytes occurs under a smaller id is decided by suffix arrays (two-stage sorting: suffixes
smaller than their successors are sorted directly, the others follow from them by scans over first-byte buckets) and
the common prefixes of neighbours in them. What has to be compared is dealt to the arrays like this:

* Texts lie in blocks of bounded size. Of every window the GRAM-byte string with the smallest hash is its anchor, so
  equal windows have equal anchors; neighbouring windows of one anchor form a piece of less than 2 * least bytes.
* Each block sends one short entry per distinct (anchor, piece) to the anchor's bucket, with the smallest id that has
  it. The bucket answers in one byte: nothing else there, held by a smaller document elsewhere, or to be compared.
  Identical pieces thus travel as ten bytes, and what no other document may share isn't sent on.
* Pieces to be compared go with their text to the anchor's bucket, once per block and content. An anchor with
  more than HOT different pieces sends their windows instead, each to a bucket of its own string: equal strings
  only meet there, at most once per block, so a line in a third of all texts is no task's burden.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgertone.session import shared_folder

from .common import remember, saved
from .jaccard import _mix

LEAST = 50
#: Bytes of an anchor.
GRAM = 24
#: Bytes of text in a block and windows hashed at once (a power of two).
BLOCK, SLICE = 4 << 20, 1 << 20
#: Pieces of an anchor in one block beyond which they share an entry, and in all beyond which windows are dealt singly.
MULTI, HOT = 32, 8192
#: Entries in a bucket on average, and bytes of text in a suffix array (more only for one anchor's pieces).
ENTRIES, ARRAY = 500_000, 1 << 20

_A, _B, _C = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


# ------------------------------------------------------------------------------------------ suffix arrays


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one big-endian number; text ends with eight bytes of padding."""
    n = len(text) - 8
    out = np.empty(n, np.uint64)
    for k in range(min(8, n)):
        out[k::8] = text[k : k + 8 * len(range(k, n, 8))].view(">u8")
    return out


def _grows(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one never is."""
    sign = np.sign(text[1:].astype(np.int16) - text[:-1])  # of the next byte less this one
    sign = np.append(sign, -1)
    # equal bytes take the answer of the next place where bytes differ
    at = np.where(sign != 0, np.arange(len(sign)), len(sign))
    return sign[np.minimum.accumulate(at[::-1])[::-1]] > 0


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in order of their first ``depth`` bytes at least, by two-stage sorting.

    Ties beyond depth are in any order. A suffix that ends counts as followed by bytes 0.
    """
    n = len(text)
    if n == 0:
        return np.empty(0, np.int64)
    grows = _grows(text)
    direct = np.flatnonzero(grows)
    words = _words(np.concatenate([text, np.zeros(depth + 16, np.uint8)]))
    for offset in reversed(range(0, depth, 8)):  # from the last eight bytes to the first, each sort stable
        direct = direct[np.argsort(words[direct + offset], kind="stable")]
    starts = np.searchsorted(text[direct], np.arange(257))
    # suffixes larger than their successors: scanning in order, each suffix places its predecessor in its byte's bucket
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    out = []
    for byte in np.unique(text).tolist():
        found, new = [], np.concatenate([*waiting[byte], np.empty(0, np.int64)])
        while len(new):
            found.append(new)
            before = new[new > 0] - 1
            new = before[text[before] == byte]
        found.append(direct[starts[byte] : starts[byte + 1]])
        found = np.concatenate(found)
        out.append(found)
        before = found[found > 0] - 1
        first = text[before]
        before, first = before[first > byte], first[first > byte]
        order = np.argsort(first, kind="stable")
        before, cuts = before[order], np.flatnonzero(np.diff(first[order])) + 1
        for part in np.split(before, cuts) if len(before) else ():
            waiting[text[part[0]]].append(part)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Equal bytes at each place and the one before it in the list, at most ``depth``; 0 for the first."""
    words = _words(np.concatenate([text, np.zeros(depth + 16, np.uint8)]))
    out = np.zeros(len(places), np.int64)
    left = np.arange(1, len(places))
    for offset in range(0, depth, 8):
        differ = words[places[left] + offset] ^ words[places[left - 1] + offset]
        same = np.full(len(left), 8)
        for k in range(8):  # bytes before the first that differs
            same[(differ >> np.uint64(8 * k)) & np.uint64(255) != 0] = 7 - k
        out[left] += same
        left = left[same == 8]
    return np.minimum(out, depth)


def held_before(flat: np.ndarray, sizes: np.ndarray, ids: np.ndarray, least: int) -> np.ndarray:
    """For each byte of the texts laid end to end: whether the ``least`` bytes from there occur in a text of a smaller id."""
    # byte 255 is in no UTF-8 text and keeps texts apart
    ends = np.cumsum(sizes + 1)
    text = np.full(int(ends[-1]) if len(ends) else 0, 255, np.uint8)
    of = np.repeat(np.arange(len(sizes)), sizes)
    text[np.arange(len(flat)) + of] = flat
    order = suffix_array(text, least)
    item = np.searchsorted(ends, order, side="right")
    whole = order + least <= ends[item] - 1
    order, item = order[whole], item[whole]
    hits = np.zeros(len(flat), bool)
    if len(order):
        first = np.flatnonzero(common_prefixes(text, order, least) < least)  # where a new string begins
        lowest = np.repeat(np.minimum.reduceat(ids[item], first), np.diff(np.append(first, len(order))))
        seen = ids[item] > lowest
        hits[order[seen] - item[seen]] = True
    return hits


# ------------------------------------------------------------------------------------------ pieces of a block


def _gram(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each place."""
    out = np.empty(len(at), np.uint64)
    for a in range(0, len(at), 1 << 16):
        w = buf[at[a : a + (1 << 16), None] + np.arange(GRAM)].view("<u8")
        out[a : a + (1 << 16)] = _mix((w[:, 0] * _A + w[:, 1]) * _B + w[:, 2])
    return out


def _anchors(buf: np.ndarray, at: int, to: int, least: int) -> np.ndarray:
    """The anchor's place for each window that starts from ``at`` up to ``to``."""
    span = least - GRAM + 1  # anchors to choose from in a window
    part = buf[at : to + least - 1]
    n = len(part) - GRAM + 1
    g = np.empty(len(part) - 7, np.uint64)
    for k in range(8):
        g[k::8] = part[k : k + 8 * len(range(k, len(g), 8))].view("<u8")
    h = _mix((g[:n] * _A + g[8 : 8 + n]) * _B + g[16 : 16 + n])
    # the place in the lowest bits: the leftmost of equal hashes wins
    low = np.uint64(2 * SLICE - 1)
    h = (h & ~low) | np.arange(n, dtype=np.uint64)
    step = 1
    while 2 * step <= span:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    if span > step:
        h = np.minimum(h[: step - span], h[span - step :])
    return (h & low).astype(np.int64) + at


class _Block:
    """Texts of a block, by id, with their pieces in order of (anchor, piece) and groups of equal ones."""

    def __init__(self, table: pa.Table, least: int):
        seq, ids = table.column("seq"), table.column("id")
        table = table.take(pc.sort_indices(pa.table({"id": ids, "seq": seq}), [("id", "ascending"), ("seq", "ascending")]))
        texts = pc.fill_null(table.column("text"), "").combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        self.known = np.asarray(table.column("id").is_valid())
        self.ids = np.asarray(pc.fill_null(table.column("id"), 0)).astype(np.int64)
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        cuts = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = texts.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
        self.buf, self.cuts, self.least = data[cuts[0] : cuts[-1]], cuts - cuts[0], least
        self._find()

    def _find(self) -> None:
        buf, cuts, least = self.buf, self.cuts, self.least
        change = np.zeros(len(buf) + 1, np.int8)
        long = self.known & (np.diff(cuts) >= least)
        change[cuts[:-1][long]] += 1
        change[cuts[1:][long] - least + 1] -= 1
        valid = np.cumsum(change, dtype=np.int8).astype(bool)
        first, ends, anchor = [], [], []
        for at in range(0, max(0, len(buf) - least + 1), SLICE):
            to = min(at + SLICE, len(buf) - least + 1)
            starts = np.flatnonzero(valid[at:to])
            place = _anchors(buf, at, to, least)[starts]
            starts = starts + at
            new = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
            first.append(starts[new])
            anchor.append(place[new])
            ends.append(starts[np.append(new[1:], len(starts)) - 1] if len(new) else starts)
        none = np.empty(0, np.int64)
        first, last, anchor = (np.concatenate([none, *x]) for x in (first, ends, anchor))
        # pieces cut by a slice's border
        new = np.append(True, (anchor[1:] != anchor[:-1]) | (first[1:] != last[:-1] + 1))[: len(first)]
        last = last[np.append(np.flatnonzero(new)[1:], len(first)) - 1] if len(first) else last
        first, anchor = first[new], anchor[new]
        a = _mix(_gram(buf, anchor) + _C)  # anchors are the smallest hashes: spread them anew over the buckets
        # four strings of GRAM bytes cover a piece; odd, as even numbers stand for many pieces
        p = (_gram(buf, first) * _A + _gram(buf, first + GRAM)) * _B
        p = (p + _gram(buf, last + least - 2 * GRAM)) * _C + _gram(buf, last + least - GRAM)
        p = _mix(p + ((last - first) * 64 + anchor - first).astype(np.uint64)) | np.uint64(1)
        order = np.lexsort((p, a))  # stable: equal pieces stay in order of id
        self.first, self.last, self.a, p = first[order], last[order], a[order], p[order]
        self.id = self.ids[np.searchsorted(cuts, self.first, side="right") - 1]
        same_a = self.a[1:] == self.a[:-1]
        head = np.append(True, ~same_a | (p[1:] != p[:-1]))[: len(p)]
        self.group = np.cumsum(head) - 1
        self.at = np.flatnonzero(head)
        self.low = self.id[self.at]  # smallest id of a group
        # entries: one per group, or one for an anchor with more than MULTI groups
        key, low, piece = self.a[self.at], self.low, p[self.at]
        lead = np.append(True, key[1:] != key[:-1])[: len(key)]
        of = np.cumsum(lead) - 1
        number = np.bincount(of, minlength=0) if len(of) else np.empty(0, np.int64)
        many = number[of] > MULTI if len(of) else np.empty(0, bool)
        send = lead | ~many
        self.entry = np.cumsum(send) - 1
        least_id = np.minimum.reduceat(low, np.flatnonzero(lead)) if len(low) else low
        self.keys = key[send]
        self.pieces = np.where(many, np.minimum(number[of] if len(of) else 0, 1 << 30).astype(np.uint64) * np.uint64(2), piece)[send]
        self.lows = np.where(many, least_id[of] if len(of) else 0, low)[send]


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    """Buckets 0 to n - 1, in the order of the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _five(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_five(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(x, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _narrow(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in as few bytes as the largest needs."""
    top = int(x.max()) if len(x) else 0
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def _by_block(limit: int):
    """Rows get the number of a block of at most ``limit`` bytes (or one longer text) and their place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, seq = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            blocks, seqs = [], []
            for n in pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist():
                if size and size + n > limit:
                    block, size, seq = block + 1, 0, 0
                blocks.append(block)
                seqs.append(seq)
                size, seq = size + n, seq + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int64()), pa.array(seqs, pa.int32()), *batch.columns], names=["block", "seq", "id", "text"]
            )

    return run


_ENTRY = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("base", pa.int64()), ("anchors", pa.binary()), ("pieces", pa.binary()), ("lows", pa.binary())])


def _entries(n: int, least: int):
    def run(key, table):
        b = _Block(table, least)
        cuts = np.searchsorted(_bucket(b.keys, n), np.arange(n + 1)).tolist()
        rows = []
        for k in range(n):
            s, e = cuts[k], cuts[k + 1]
            if s < e:
                base = int(b.lows[s:e].min())
                lows = _narrow((b.lows[s:e] - base).astype(np.uint64))
                rows.append((key[0].as_py(), k, base, _five(b.keys[s:e]), _five(b.pieces[s:e]), lows.tobytes()))
        return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ENTRY)], schema=_ENTRY)

    return run


#: Answers to an entry.
ALONE, BEFORE, COMPARE, SINGLY = 0, 1, 2, 3


def _answers(table: pa.Table) -> pa.Table:
    """One byte for each entry of a bucket."""
    anchors = [_from_five(x.as_py()) for x in table.column("anchors")]
    sizes = np.array([len(x) for x in anchors])
    a = np.concatenate([np.empty(0, np.uint64), *anchors])
    p = np.concatenate([np.empty(0, np.uint64), *[_from_five(x.as_py()) for x in table.column("pieces")]])
    low = []
    for base, raw, n in zip(table.column("base"), table.column("lows"), sizes.tolist(), strict=True):
        low.append(np.frombuffer(raw.as_py(), f"<u{len(raw.as_py()) // n}").astype(np.int64) + base.as_py())
    low = np.concatenate([np.empty(0, np.int64), *low])
    order = np.lexsort((low, p, a))
    a, p, low = a[order], p[order], low[order]
    head = np.append(True, (a[1:] != a[:-1]) | (p[1:] != p[:-1]))[: len(a)]
    first = low[np.flatnonzero(head)][np.cumsum(head) - 1]
    many = p % np.uint64(2) == 0
    lead = np.append(True, a[1:] != a[:-1])[: len(a)]
    number = np.add.reduceat(np.where(many, p // np.uint64(2), head).astype(np.int64), np.flatnonzero(lead)) if len(a) else np.empty(0, np.int64)
    number = number[np.cumsum(lead) - 1]
    code = np.where(number > HOT, SINGLY, np.where(number > 1, COMPARE, ALONE))
    code[~many & (low > first)] = BEFORE
    out = np.empty(len(code), np.uint8)
    out[order] = code
    parts = np.split(out, np.cumsum(sizes)[:-1])
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "codes": pa.array([x.tobytes() for x in parts], pa.binary())})


def _united(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges that overlap or touch as one, in order."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])[: len(start)]
    at = np.flatnonzero(new)
    return start[at], end[np.append(at[1:], len(start)) - 1] if len(at) else end


def _ranges(start: np.ndarray, end: np.ndarray) -> bytes:
    return np.concatenate(_united(start, end)).astype("<i8").tobytes()


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each range, one range after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


#: bucket null: ranges of a block known to go; else pieces to be compared: keys, ids, sizes, text, how many places, places.
_FOUND = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), *[(c, pa.binary()) for c in ("ranges", "keys", "ids", "sizes", "text", "counts", "places")]])


def _found(n: int, least: int):
    def run(key, table, answers):
        b = _Block(table, least)
        block = key[0].as_py()
        answers = answers.sort_by("bucket")
        codes = np.frombuffer(b"".join(x.as_py() for x in answers.column("codes")), np.uint8)
        if len(codes) != len(b.keys):
            raise ValueError("the answers do not belong to this block")
        code = codes[b.entry][b.group] if len(codes) else np.empty(0, np.uint8)
        lowest = b.id == b.low[b.group] if len(code) else np.empty(0, bool)
        gone = ~lowest | (code == BEFORE)
        start, end = [b.first[gone]], [b.last[gone] + least]
        # pieces as a whole, each content once with all its places in texts of its lowest id
        pick = np.flatnonzero(lowest & (code == COMPARE))
        sets = [(b.a[pick], b.id[pick], b.first[pick], (b.last - b.first)[pick] + least, b.group[pick])]
        # windows of anchors with very many pieces
        pick = np.flatnonzero(lowest & (code == SINGLY))
        size = (b.last - b.first)[pick] + 1
        at, ids = _spread(b.first[pick], size), np.repeat(b.id[pick], size)
        w = _mix((_gram(b.buf, at) * _A + _gram(b.buf, at + GRAM)) * _B + _gram(b.buf, at + least - GRAM))
        order = np.lexsort((at, ids, w))
        at, ids, w = at[order], ids[order], w[order]
        head = np.append(True, w[1:] != w[:-1])[: len(w)]
        group = np.cumsum(head) - 1
        lowest = ids == ids[np.flatnonzero(head)][group] if len(w) else np.empty(0, bool)
        start.append(at[~lowest])
        end.append(at[~lowest] + least)
        sets.append((w[lowest], ids[lowest], at[lowest], np.full(int(lowest.sum()), least), group[lowest]))
        rows = [(block, None, _ranges(np.concatenate(start), np.concatenate(end)), *[None] * 6)]
        for keys, ids, places, sizes, group in sets:
            head = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)])
            counts = np.diff(np.append(head, len(group)))
            bucket = _bucket(keys[head], n)
            for k in np.unique(bucket).tolist():
                s, e = np.searchsorted(bucket, [k, k + 1])
                h, c = head[s:e], counts[s:e]
                text = b.buf[_spread(places[h], sizes[h])]
                where = places[h[0] : h[-1] + c[-1]]
                rows.append(
                    (block, k, None, keys[h].tobytes(), ids[h].tobytes(), sizes[h].astype("<i2").tobytes(), text.tobytes(),
                     c.astype("<i8").tobytes(), where.astype("<i8").tobytes())
                )
        return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_FOUND)], schema=_FOUND)

    return run


def _compared(least: int):
    """Ranges of each block that suffix arrays over the pieces of a bucket show to occur under a smaller id."""

    def run(table: pa.Table) -> pa.Table:
        col = lambda c, t: np.concatenate([np.empty(0, t), *[np.frombuffer(x.as_py(), t) for x in table.column(c)]])
        keys, ids, sizes = col("keys", np.uint64), col("ids", np.int64), col("sizes", np.int16).astype(np.int64)
        text, counts, places = col("text", np.uint8), col("counts", np.int64), col("places", np.int64)
        block = np.repeat(np.asarray(table.column("block")), [len(x.as_py()) // 8 for x in table.column("keys")])
        text_at, place_at = np.cumsum(sizes) - sizes, np.cumsum(counts) - counts
        order = np.argsort(keys, kind="stable")
        # a key of one piece has nothing to compare
        new = np.append(True, np.diff(keys[order]) != 0)[: len(order)]
        order = order[~(new & np.append(new[1:], True)[: len(new)])]
        new = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0)[: len(order)])
        before = np.append(0, np.cumsum(sizes[order]))
        got: list[tuple[np.ndarray, ...]] = []
        k = 0
        while k < len(new):
            to = max(k + 1, int(np.searchsorted(before[new], before[new[k]] + ARRAY)))
            some = order[new[k] : new[to] if to < len(new) else len(order)]
            k = to
            hits = held_before(text[_spread(text_at[some], sizes[some])], sizes[some], ids[some], least)
            # neighbouring hits of one piece are one range, at each of its places
            of = np.repeat(np.arange(len(some)), sizes[some])
            at = np.flatnonzero(hits)
            head = np.append(True, (np.diff(at) != 1) | (np.diff(of[at]) != 0))[: len(at)]
            first = np.flatnonzero(head)
            last = at[np.append(first[1:], len(at)) - 1] if len(at) else at
            first = at[first]
            item = of[first]
            offset = np.cumsum(sizes[some]) - sizes[some]
            each = counts[some][item]
            where = places[_spread(place_at[some][item], each)]
            start = where + np.repeat(first - offset[item], each)
            got.append((np.repeat(block[some][item], each), start, start + np.repeat(last - first, each) + least))
        none = np.empty(0, np.int64)
        block, start, end = (np.concatenate([none, *x]) for x in (zip(*got, strict=True) if got else ([], [], [])))
        rows = [(k, _ranges(start[block == k], end[block == k])) for k in np.unique(block).tolist()]
        return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "ranges": pa.array([r[1] for r in rows], pa.binary())})

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut(key, table, ranges):
    """Rows of a block with the spans to be removed and the bytes that remain."""
    order = pc.sort_indices(pa.table({"id": table.column("id"), "seq": table.column("seq")}), [("id", "ascending"), ("seq", "ascending")])
    table = table.take(order)
    texts = [(t or "").encode("utf-8", "surrogatepass") for t in table.column("text").to_pylist()]
    cuts = np.append(0, np.cumsum([len(t) for t in texts]))
    raw = [np.frombuffer(x.as_py(), "<i8").reshape(2, -1) for x in ranges.column("ranges")]
    start, end = _united(*np.concatenate([np.empty((2, 0), np.int64), *raw], axis=1))
    # ranges of neighbouring texts that touch are cut at the border again
    a, b = np.searchsorted(end, cuts[:-1], side="right").tolist(), np.searchsorted(start, cuts[1:]).tolist()
    spans, kept = [], []
    for k, text in enumerate(texts):
        inside = np.stack([start[a[k] : b[k]], end[a[k] : b[k]]], axis=1) - cuts[k]
        own = [(s, e) for s, e in inside.clip(0, len(text)).tolist() if s < e]
        spans.append([{"start": s, "end": e} for s, e in own])
        edges = [0, *[x for span in own for x in span], len(text)]
        kept.append(b"".join(text[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)))
    sizes = pa.array([len(t) for t in texts], pa.int64())
    return pa.table({"id": table.column("id").cast(pa.int64()), "n_bytes": sizes, "spans": pa.array(spans, _SPANS), "kept": pa.array(kept, pa.binary())})


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id_col bigint, n_bytes, spans array<struct<start,end>>, kept binary) of every whole text, one row per input row.

    Spans are the maximal stretches of UTF-8 bytes covered by strings of ``least`` bytes that also start in a row with a
    smaller id, judged on the input; kept is the rest, which need not be UTF-8. Strings never cross rows. Null and
    empty texts have no bytes. A row without an id keeps all and takes from none; rows with equal ids do not
    take from each other, but both from smaller ones. An empty table gives an empty one; further columns are ignored.
    ``least`` is from 2 * GRAM to 4 * GRAM - 1. Ids of pieces are 39 + 40 bits of two hashes and the bucket's number.
    """
    if not 2 * GRAM <= least < 4 * GRAM:
        raise ValueError(f"least must be from {2 * GRAM} to {4 * GRAM - 1}")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    # kept in buckets by block: the three passes over the texts then move none of them
    name, parts = f"blocks_{uuid.uuid4().hex}", max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = remember(f"{shared_folder(spark)}/{name}")
    (
        rows.mapInArrow(_by_block(BLOCK), "block bigint, seq int, id bigint, text string")
        .write.bucketBy(parts, "block").option("path", path).option("compression", "zstd").saveAsTable(name)
    )
    blocks = spark.table(name)
    size = blocks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(size * 2 / (least - GRAM + 2) / ENTRIES) + 1
    text = lambda schema: ", ".join(f"{f.name} {'bigint' if f.type == pa.int64() else 'binary'}" for f in schema)
    by_block = blocks.groupBy("block")
    entries = by_block.applyInArrow(_entries(n, least), text(_ENTRY))
    answers = entries.groupBy("bucket").applyInArrow(_answers, "block bigint, bucket bigint, codes binary")
    found = saved(by_block.cogroup(answers.groupBy("block")).applyInArrow(_found(n, least), text(_FOUND)), "found")
    compared = found.where("bucket is not null").groupBy("bucket").applyInArrow(_compared(least), "block bigint, ranges binary")
    ranges = found.where("bucket is null").select("block", "ranges").union(compared)
    done = by_block.cogroup(ranges.groupBy("block")).applyInArrow(
        _cut, "id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    )
    return done.withColumnRenamed("id", id_col)
