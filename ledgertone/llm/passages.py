"""Passages that documents share, exactly or with changes: shared k-mer seeds, collinear chains, alignment.

Each text gives a seed, the hash of K words, in every window of W starts. Every seed is joined with its first
occurrence only (the smallest id), so a passage in a third of all texts makes one match per seed and copy, never
pairs of copies. The matches of one text with one earlier text are chained in order, with gap costs, by prefix maxima
in a Fenwick tree; chains are then aligned word by word and carried on beyond their ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved
from .jaccard import _chunks, _mix

#: Words in a seed, and seed starts among which one is taken: every equal run of K + W - 1 words holds a seed.
K, W = 8, 16
#: Cost of a word left out of a chain, and the largest gap within one.
GAP_COST, MOST_GAP = 0.25, 40
#: Words looked at beyond a chain's ends.
PAD = 48
#: Words of a passage at least, of one aligned piece of it, and the share of equal words in a piece.
MIN_WORDS, PIECE, SAME = 50, 20, 0.8


def word_hashes(texts: list[bytes | None]) -> list[np.ndarray]:
    """A hash for each word of each text, A-Z folded to lower case."""
    table: dict[bytes, int] = {}
    codes = []
    for text in texts:
        words = text.lower().split() if text else []
        codes.append(np.fromiter((table.setdefault(w, len(table)) for w in words), np.int64, len(words)))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, table), np.uint64, len(table))
    return [hashes[c] for c in codes]


def _sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every w neighbours, by doubling; w is a power of two and at most len(x)."""
    step = 1
    while step < w:
        x = pick(x[:-step], x[step:])
        step *= 2
    return x


def seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the k-mers that are smallest in some window; k-mers of fewer than three different words are none."""
    n = len(words) - K + 1
    if n < 1:
        return words[:0], np.empty(0, np.int64)
    key = np.zeros(n, np.uint64)
    for k in range(K):
        key = key * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    key = _mix(key)
    if n <= W:
        at = np.flatnonzero(key == key.min())
    else:
        low = _sliding(key, W, np.minimum)
        # a k-mer is smallest in some window holding it if the largest of those windows' minima is its own
        ends = np.zeros(W - 1, np.uint64)
        at = np.flatnonzero(_sliding(np.concatenate([ends, low, ends]), W, np.maximum) == key)
    runs = np.stack([words[at + k] for k in range(K)], 1) if len(at) else np.empty((0, K), np.uint64)
    rich = (np.diff(np.sort(runs, 1), axis=1) != 0).sum(1) >= 2
    return key[at[rich]], at[rich]


_SEEDS = "uid bigint, seed bigint, pos int"


def _seed_rows():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, group in _chunks(batch, "text"):
                got = [seeds(w) for w in word_hashes(group)]
                of = np.repeat(np.arange(first, first + len(group)), [len(k) for k, _ in got])
                key, pos = (np.concatenate([g[i] for g in got]) for i in (0, 1))
                own = [batch.column(c).take(pa.array(of)) for c in ("id", "uid")]
                made = [pa.array(key.view(np.int64)), pa.array(pos.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*own, *made], names=["id", "uid", "seed", "pos"])

    return run


class Fenwick:
    """Largest (value, item) among the first so many places."""

    def __init__(self, size: int):
        self.tree: list[tuple[float, int]] = [(-1e18, -1)] * (size + 1)

    def put(self, place: int, value: float, item: int) -> None:
        place += 1
        while place < len(self.tree):
            if value > self.tree[place][0]:
                self.tree[place] = (value, item)
            place += place & -place

    def best(self, count: int) -> tuple[float, int]:
        out = (-1e18, -1)
        while count > 0:
            out = max(out, self.tree[count])
            count -= count & -count
        return out


def merge_diagonal(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int]]:
    """Matches (x, y) as segments (x, y, length): neighbours on one diagonal become one."""
    diagonal = y - x
    order = np.lexsort((x, diagonal))
    x, y, diagonal = x[order], y[order], diagonal[order]
    cut = np.flatnonzero((np.diff(diagonal) != 0) | (np.diff(x) > K + W)) + 1
    first, last = np.append(0, cut), np.append(cut, len(x)) - 1
    return sorted(zip(x[first].tolist(), y[first].tolist(), (x[last] - x[first] + K).tolist(), strict=True))


def chain(segments: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Segments in order in both texts, best chains first; each segment is in one chain.

    The best chain that ends with a segment is its length plus, over segments that end before it in both texts, the
    largest score less GAP_COST for every word between. The cost is a difference of end and start, so the largest is
    a prefix maximum over ends in the second text, taken while sweeping over the first.
    """
    if len(segments) == 1:
        return [list(segments)]
    ends = sorted({y + n for _, y, n in segments})
    place = {e: i for i, e in enumerate(ends)}
    starts = np.searchsorted(ends, [y for _, y, _ in segments], side="right")
    sweep = sorted([(x, 1, i) for i, (x, _, _) in enumerate(segments)] + [(x + n, 0, i) for i, (x, _, n) in enumerate(segments)])
    tree, score, parent = Fenwick(len(ends)), [0.0] * len(segments), [-1] * len(segments)
    for _, begins, i in sweep:
        x, y, n = segments[i]
        if begins:
            value, j = tree.best(int(starts[i]))
            gain = value - GAP_COST * (x + y)
            score[i] = n + max(0.0, gain)
            parent[i] = j if gain > 0 else -1
        else:
            tree.put(place[y + n], score[i] + GAP_COST * (x + n + y + n), i)
    used, out = set(), []
    for i in sorted(range(len(segments)), key=lambda i: -score[i]):
        own = []
        while i >= 0 and i not in used:
            used.add(i)
            own.append(segments[i])
            i = parent[i]
        own.reverse()
        part: list[tuple[int, int, int]] = []
        for s in own:
            if part and max(s[0] - part[-1][0] - part[-1][2], s[1] - part[-1][1] - part[-1][2]) > MOST_GAP:
                out.append(part)
                part = []
            part.append(s)
        if part:
            out.append(part)
    return out


def _beyond(same: np.ndarray) -> int:
    """How far a passage goes on: to the best sum of 1 for an equal word and -2 for another, given up 6 below it."""
    if not len(same):
        return 0
    sums = np.cumsum(np.where(same, 1, -2))
    drop = np.flatnonzero(np.maximum.accumulate(np.maximum(sums, 0)) - sums > 6)
    sums = sums[: drop[0]] if len(drop) else sums
    return int(sums.argmax()) + 1 if len(sums) and sums.max() > 0 else 0


#: Words left out on either side, in order of cost, after which a passage may go on.
SKIPS = sorted(((i, j) for i in range(4) for j in range(4) if i or j), key=lambda s: (max(s), sum(s)))


def extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int, np.ndarray]:
    """(words of a, words of b, places of equal words) by which two runs that begin together go on alike.

    Where equal places end, up to three words may be left out on either side if five equal ones follow.
    """
    i = j = 0
    equal = []
    while True:
        n = min(len(a) - i, len(b) - j)
        same = a[i : i + n] == b[j : j + n]
        far = _beyond(same)
        equal.append(np.flatnonzero(same[:far])[:, None] + [i, j])
        i, j = i + far, j + far
        for p, q in SKIPS:
            x, y = a[i + p : i + p + 5], b[j + q : j + q + 5]
            if len(x) == 5 == len(y) and (x == y).all():
                i, j = i + p, j + q
                break
        else:
            return i, j, np.concatenate(equal)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the words in a longest common subsequence of two short runs."""
    rows = [np.zeros(len(b) + 1, np.int64)]
    for x in a:
        # a cell is the larger of the one above and the diagonal plus a match, carried on to the right
        rows.append(np.maximum.accumulate(np.maximum(rows[-1], np.append(0, rows[-1][:-1] + (b == x)))))
    i, j, out = len(a), len(b), []
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return np.array(out[::-1], np.int64).reshape(-1, 2)


def align(a: np.ndarray, b: np.ndarray, segments: list[tuple[int, int, int]]) -> tuple[int, int, int, int, np.ndarray]:
    """(start, end) in a, (start, end) in b and the places of equal words, for a chain placed in the word hashes a and b."""
    x0, y0, _ = segments[0]
    x1, y1 = segments[-1][0] + segments[-1][2], segments[-1][1] + segments[-1][2]
    left_a, left_b, before = extend(a[:x0][::-1], b[:y0][::-1])
    right_a, right_b, after = extend(a[x1:], b[y1:])
    equal = [[x0 - 1, y0 - 1] - before[::-1]]
    px, py = x0, y0
    for x, y, size in segments:
        if x - px != y - py:
            equal.append(_common(a[px:x], b[py:y]) + [px, py])
            px, py = x, y
        equal.append(np.flatnonzero(a[px : x + size] == b[py : y + size])[:, None] + [px, py])
        px, py = x + size, y + size
    equal.append(after + [x1, y1])
    return x0 - left_a, x1 + right_a, y0 - left_b, y1 + right_b, np.concatenate(equal)


def alike(a: np.ndarray, b: np.ndarray, segments: list[tuple[int, int, int]], piece: int, same: float) -> list[tuple[int, int, int, int, int]]:
    """(start, end) in a, (start, end) in b and number of equal words of every piece of an aligned chain.

    A piece has at least ``piece`` words, ``same`` of them equal. That is the whole chain or, if its share is too small,
    each longest stretch of runs of equal words whose share is not, down to single runs, so none is lost for what
    stands beside it. A run at an end of a stretch has at least twice the words of the gap next to it.
    """
    s, e, t, f, equal = align(a, b, segments)
    if len(equal) >= same * max(e - s, f - t):
        return [(s, e, t, f, len(equal))] if e - s >= piece else []
    cut = np.flatnonzero((np.diff(equal, axis=0) != 1).any(1)) + 1
    first, last = np.append(0, cut), np.append(cut, len(equal)) - 1
    starts, ends = equal[first], equal[last] + 1
    n, gap = last - first + 1, (starts[1:] - ends[:-1]).max(1)
    begins, closes = np.append(n[:-1] >= 2 * gap, True), np.append(True, n[1:] >= 2 * gap)
    out, done = [], -1
    for i in range(len(n)):
        # a stretch that ends no later than one found before is a part of it
        k = max(i, done + 1)
        till = len(n) if begins[i] else i + 1
        words = ends[k:till] - starts[i]
        kept = last[k:till] - first[i] + 1
        good = (words[:, 0] >= piece) & (kept >= same * words.max(1)) & (closes[k:till] | (np.arange(k, till) == i))
        if good.any():
            done = k + int(np.flatnonzero(good)[-1])
            (x, y), (u, v) = starts[i].tolist(), ends[done].tolist()
            out.append((x, u, y, v, int(last[done] - first[i] + 1)))
    return out


_CHAIN = pa.schema(
    [("uid", pa.int64()), ("ruid", pa.int64()), ("x", pa.list_(pa.int32())), ("y", pa.list_(pa.int32())), ("size", pa.list_(pa.int32())),
     ("a0", pa.int32()), ("a1", pa.int32()), ("b0", pa.int32()), ("b1", pa.int32())]
)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by uid and ruid: a pair of texts may go on in the next batch."""

    def done(uid, ruid, x, y) -> list[dict]:
        out = []
        for own in chain(merge_diagonal(np.concatenate(x).astype(np.int64), np.concatenate(y).astype(np.int64))):
            xs, ys, sizes = (list(c) for c in zip(*own, strict=True))
            out.append(
                {"uid": uid, "ruid": ruid, "x": xs, "y": ys, "size": sizes, "a0": max(0, xs[0] - PAD), "a1": xs[-1] + sizes[-1] + PAD,
                 "b0": max(0, ys[0] - PAD), "b1": ys[-1] + sizes[-1] + PAD}
            )
        return out

    held: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        uid, ruid, pos, rpos = (batch.column(c).to_numpy() for c in ("uid", "ruid", "pos", "rpos"))
        cut = np.flatnonzero((np.diff(uid) != 0) | (np.diff(ruid) != 0)) + 1
        rows = []
        for a, b in zip(np.append(0, cut), np.append(cut, len(uid)), strict=True):
            if held and (held[0], held[1]) != (uid[a], ruid[a]):
                rows += done(*held)
                held = None
            held = held or (int(uid[a]), int(ruid[a]), [], [])
            held[2].append(pos[a:b])
            held[3].append(rpos[a:b])
        yield pa.RecordBatch.from_pylist(rows, schema=_CHAIN)
    if held:
        yield pa.RecordBatch.from_pylist(done(*held), schema=_CHAIN)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("uid", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("words", pa.binary())])
    for batch in batches:
        for first, group in _chunks(batch, "text"):
            out = []
            for k, words in enumerate(word_hashes(group), first):
                short = (words >> np.uint64(32)).astype(np.uint32)
                for s in batch.column("spans")[k].as_py():
                    out.append((batch.column("uid")[k].as_py(), s["a"], s["b"], short[s["a"] : s["b"]].tobytes()))
            yield pa.record_batch([pa.array([o[i] for o in out], f.type) for i, f in enumerate(schema)], schema=schema)


_FOUND = "uid bigint, ruid bigint, start int, end int, ref_start int, ref_end int, matched int"


def _aligned(piece: int, same: float):
    schema = pa.schema([(c.split()[0], pa.int64() if "bigint" in c else pa.int32()) for c in _FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                a, b = np.frombuffer(r["wa"], np.uint32), np.frombuffer(r["wb"], np.uint32)
                own = [(x - r["a0"], y - r["b0"], n) for x, y, n in zip(r["x"], r["y"], r["size"], strict=True)]
                for s, e, t, f, equal in alike(a, b, own, piece, same):
                    out.append((r["uid"], r["ruid"], s + r["a0"], e + r["a0"], t + r["b0"], f + r["b0"], equal))
            yield pa.record_batch([pa.array([o[i] for o in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def merged(spans: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Spans that overlap or touch (two words apart at most) as one, those of at least so many words."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1] + 2:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out if e - s >= least]


def _merge(least: int):
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                [{"start": s, "end": e} for s, e in merged([(p["start"], p["end"]) for p in row], least)]
                for row in batch.column("pieces").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(made, spans)], names=["uid", "spans"])

    return run


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows as one struct, with id, text and uid: rows equal in id and text are one document."""
    text = F.col(text_col).cast("string")
    return docs.select(
        F.struct("*").alias("row"), F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(F.col(id_col).cast("string"), text).alias("uid")
    )


def _clusters(x: list[list[int]], size: list[list[int]], least: int) -> list[tuple[int, int]]:
    """Ranges of places where an equal run of ``least`` words may start: its seeds lie at most W apart and from its ends."""
    out: list[list[int]] = []
    for s, n in sorted((s, n) for xs, sizes in zip(x, size, strict=True) for s, n in zip(xs, sizes, strict=True)):
        if out and s <= out[-1][1] + W:
            out[-1][1] = max(out[-1][1], s + n)
        else:
            out.append([s, s + n])
    return [(max(0, s - W), e + W - least + 1) for s, e in out if e + W - least >= max(0, s - W)]


def _without(ranges: list[tuple[int, int]], gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of the ranges that are in none of those gone, which are in order."""
    out = []
    for a, b in ranges:
        for s, e in gone:
            if a < s < b:
                out.append((a, s))
            if s < b and a < e:
                a = e
        if a < b:
            out.append((a, b))
    return out


_RANGES = "array<struct<a:int,b:int>>"


def _starts(least: int):
    """Where equal runs may start in a text, and where they would not be inside passages already found."""
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    listed = lambda ranges: [{"a": a, "b": b} for a, b in ranges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, open_ = [], []
            for x, size, spans in zip(*(batch.column(c).to_pylist() for c in ("x", "size", "spans")), strict=True):
                ranges = _clusters(x, size, least)
                done = [(p["start"], p["end"] - least + 1) for p in spans or () if p["end"] - p["start"] >= least]
                every.append(listed(ranges))
                open_.append(listed(_without(ranges, sorted(done))))
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(every, kind), pa.array(open_, kind)], names=["uid", "every", "open"])

    return run


def _run_rows(least: int):
    """A key for each run of ``least`` words that starts in the ranges ``every`` of a text; wanted if in ``open`` too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, group in _chunks(batch, "text"):
                of, keys, places, wanted = [], [], [], []
                for k, words in enumerate(word_hashes(group), first):
                    n = len(words) - least + 1
                    if n < 1:
                        continue
                    key, inside, asked = np.zeros(n, np.uint64), np.zeros(n, bool), np.zeros(n, bool)
                    for i in range(least):
                        key = key * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
                    for c, mark in (("every", inside), ("open", asked)):
                        for r in batch.column(c)[k].as_py() or ():
                            mark[r["a"] : r["b"]] = True
                    at = np.flatnonzero(inside | asked)
                    of.append(np.full(len(at), k))
                    keys.append(_mix(key[at]))
                    places.append(at.astype(np.int32))
                    wanted.append(asked[at])
                if of:
                    own = [batch.column(c).take(pa.array(np.concatenate(of))) for c in ("id", "uid")]
                    made = [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(places)), pa.array(np.concatenate(wanted))]
                    yield pa.RecordBatch.from_arrays([*own, *made], names=["id", "uid", "seed", "pos", "wanted"])

    return run


def _joined_runs(least: int):
    """Equal runs of a pair of texts as pieces: neighbours on one diagonal become one."""
    schema = pa.schema([(c.split()[0], pa.int64() if "bigint" in c else pa.int32()) for c in _FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for uid, ruid, at in zip(*(batch.column(c).to_pylist() for c in ("uid", "ruid", "at")), strict=True):
                x, d = np.unique(np.array([(p["rpos"] - p["pos"], p["pos"]) for p in at]), axis=0).T[::-1]
                cut = np.flatnonzero((np.diff(d) != 0) | (np.diff(x) > least)) + 1
                for i, j in zip(np.append(0, cut).tolist(), (np.append(cut, len(x)) - 1).tolist(), strict=True):
                    s, e, shift = int(x[i]), int(x[j]) + least, int(d[i])
                    out.append((uid, ruid, s, e, s + shift, e + shift, e - s))
            yield pa.record_batch([pa.array([o[i] for o in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def _exact(texts: DataFrame, chains: DataFrame, pieces: DataFrame, least: int) -> DataFrame:
    """Pieces of ``least`` equal words or more, outside the passages of ``pieces``, each with its own first holder.

    The first holder of a seed may hold less of a passage than a later one. Every seed of an equal run is in a chain of
    the later text, so runs of the full length are looked up where chains lie close enough for one and no passage is
    found yet; who else may hold such a run has chains with the same first holders or is one.
    """
    near = lambda d: d.groupBy("uid").agg(F.collect_list("x").alias("x"), F.collect_list("size").alias("size"))
    made = f"uid bigint, every {_RANGES}, open {_RANGES}"
    own = near(chains.select("uid", "x", "size")).join(_spans(pieces, least), "uid", "left").mapInArrow(_starts(least), made)
    wanted = saved(own.where("size(open) > 0").select("uid", "open"), "open")
    asking = chains.join(wanted.select("uid"), "uid", "left_semi")
    shared = chains.join(asking.select("ruid").distinct(), "ruid", "left_semi").select("uid", "x", "size")
    holders = near(shared.union(asking.select("ruid", "y", "size"))).withColumn("spans", F.expr("cast(null as array<struct<start:int,end:int>>)"))
    ranges = saved(holders.mapInArrow(_starts(least), made).drop("open").join(wanted, "uid", "left").where("size(every) > 0"), "ranges")
    schema = T.StructType([texts.schema["id"], *T._parse_datatype_string(_SEEDS + ", wanted boolean").fields])
    found = saved(texts.join(ranges, "uid").select("id", "uid", "text", "every", "open").mapInArrow(_run_rows(least), schema), "runs")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "uid", "pos")
    first = found.groupBy("seed").agg(F.min(place).alias("first"), F.count("*").alias("c"), F.max("wanted").alias("w")).where("c > 1 and w")
    first = first.select("seed", F.col("first.uid").alias("ruid"), F.col("first.pos").alias("rpos"))
    met = found.where("wanted").select("seed", "uid", "pos").join(first, "seed").where("uid <> ruid")
    lists = met.groupBy("uid", "ruid").agg(F.collect_list(F.struct("pos", "rpos")).alias("at"))
    return saved(lists.mapInArrow(_joined_runs(least), _FOUND), "exact")


def _pieces(rows: DataFrame, piece: int, same: float, least: int) -> DataFrame:
    """Saved table of aligned pieces between a document (uid) and an earlier one (ruid), in words."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = rows.select("id", "uid", F.col("text").cast("binary").alias("text"))
    schema = T.StructType([rows.schema["id"], *T._parse_datatype_string(_SEEDS).fields])
    found = texts.mapInArrow(_seed_rows(), schema)
    place = F.struct(F.col("id").isNull().alias("none"), "id", "uid", "pos")
    first = found.groupBy("seed").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1")
    first = first.select("seed", F.col("first.uid").alias("ruid"), F.col("first.pos").alias("rpos"))
    matches = found.select("seed", "uid", "pos").join(first, "seed").where("uid <> ruid").select("uid", "ruid", "pos", "rpos")
    chains = saved(
        matches.repartition(n, "uid").sortWithinPartitions("uid", "ruid", "pos", "rpos").mapInArrow(
            _chains, "uid bigint, ruid bigint, x array<int>, y array<int>, size array<int>, a0 int, a1 int, b0 int, b1 int"
        ), "chains",
    )
    ends = chains.select("uid", "a0", "a1").union(chains.select("ruid", "b0", "b1"))
    spans = saved(ends.groupBy("uid").agg(F.collect_set(F.struct(F.col("a0").alias("a"), F.col("a1").alias("b"))).alias("spans")), "spans")
    slices = saved(
        texts.select("uid", "text").join(spans, "uid")
        .mapInArrow(_slices, "uid bigint, a int, b int, words binary").groupBy("uid", "a", "b").agg(F.first("words").alias("words")),
        "slices",
    )
    side = lambda u, a, b, w: slices.select(F.col("uid").alias(u), F.col("a").alias(a), F.col("b").alias(b), F.col("words").alias(w))
    both = chains.join(side("uid", "a0", "a1", "wa"), ["uid", "a0", "a1"]).join(side("ruid", "b0", "b1", "wb"), ["ruid", "b0", "b1"])
    pieces = saved(both.mapInArrow(_aligned(piece, same), _FOUND), "pieces")
    return pieces.union(_exact(texts, chains, pieces, max(least, K + W - 1)))


def _spans(pieces: DataFrame, least: int) -> DataFrame:
    """(uid, spans): for each document the passages that earlier documents hold, in words."""
    lists = pieces.select("uid", "start", "end").distinct().groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("pieces"))
    out = lists.mapInArrow(_merge(least), "uid bigint, spans array<struct<start:int,end:int>>")
    return saved(out.where("size(spans) > 0"), "passages")


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, piece: int = PIECE, same: float = SAME
) -> DataFrame:
    """One row per aligned piece of a repeated passage: id, start_word, n_words, ref id, ref_start_word, ref_n_words, matched.

    A passage is ``min_words`` words or more that earlier documents (smaller id; a null id is last) hold too, in
    pieces of at least ``piece`` words of which ``same`` are equal in order; pieces may come from different documents.
    Words are as in ``[^\\x20\\x09-\\x0D]+``, A-Z folded. Null and empty texts and those of under K words have none;
    rows equal in id and text are one document; an empty table gives an empty one.
    """
    rows = _identified(docs, id_col, text_col)
    pieces = _pieces(rows, piece, same, min_words)
    spans = _spans(pieces, min_words)
    inside = F.expr("exists(spans, s -> s.start <= start AND `end` <= s.`end`)")
    hits = pieces.join(spans, "uid").where(inside).drop("spans")
    names = saved(
        rows.select("uid", "id").join(hits.select("uid").union(hits.select("ruid")).distinct(), "uid", "left_semi").distinct(), "names"
    )
    ref = names.select(F.col("uid").alias("ruid"), F.col("id").alias("ref"))
    return hits.join(names, "uid").join(ref, "ruid").select(
        F.col("id").alias(id_col), F.col("start").alias("start_word"), (F.col("end") - F.col("start")).alias("n_words"),
        F.col("ref").alias(f"ref_{id_col}"), F.col("ref_start").alias("ref_start_word"),
        (F.col("ref_end") - F.col("ref_start")).alias("ref_n_words"), "matched",
    )


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the blanks after them."""
    raw = text.encode("utf-8", "surrogatepass")
    blank = np.isin(np.frombuffer(raw, np.uint8), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
    starts = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    starts = np.append(starts, len(raw))
    out, at = [], 0
    for s, e in sorted(spans):
        out.append(raw[at : starts[min(s, len(starts) - 1)]])
        at = int(starts[min(e, len(starts) - 1)])
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [
            t if not spans else cut_words(t, [(s["start"], s["end"]) for s in spans])
            for t, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(texts, pa.string()), pa.array([bool(s) for s in batch.column("spans").to_pylist()])],
            names=["row", "text", "cut"],
        )


def cut_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, piece: int = PIECE, same: float = SAME,
    size_col: str | None = None,
) -> DataFrame:
    """The documents without the passages that earlier ones hold; the first occurrence stays where it is.

    A document of which no word is left goes; others keep their row, with ``size_col``, if given, set to the new
    number of characters where something was cut. Everything else is as in ``repeated_passages``.
    """
    rows = _identified(docs, id_col, text_col)
    spans = _spans(_pieces(rows, piece, same, min_words), min_words)
    # the new text replaces the row's own, which need not travel beside it
    beside = F.struct(*[F.col("row")[c].alias(c) for c in docs.columns if c != text_col] or [F.lit(0)])
    marked = rows.join(spans, "uid", "left").select(beside.alias("row"), "text", "spans")
    schema = T.StructType([marked.schema["row"], T.StructField("text", T.StringType()), T.StructField("cut", T.BooleanType())])
    done = marked.mapInArrow(_cut, schema).withColumnRenamed("text", "_text").withColumnRenamed("cut", "_cut")
    done = done.where(~F.col("_cut") | F.col("_text").rlike(r"[^\x20\x09-\x0D]"))
    new = {text_col: F.col("_text")}
    if size_col:
        new[size_col] = F.when(F.col("_cut"), F.length("_text")).otherwise(F.col("row")[size_col])
    return done.select(*[new.get(c, F.col("row")[c]).cast(t).alias(c) for c, t in docs.dtypes])
