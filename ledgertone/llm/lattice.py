"""Near-duplicate vectors by lattice hashing: random projections to 8 dimensions, decoded to points of the E8 lattice.

In each of several tables a vector lies in the cell of its nearest lattice point and probes the cells of neighbouring
points. Vectors that meet in a cell, one of them at home there, are compared by cosine in double precision. A linked
pair is counted only in the first table and cell where it meets, which both can tell from their lists of cells; so a
cell returns one row per vector (its links there and the smallest vector it hangs together with) and never pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, joined_small, saved

#: Tables, neighbouring cells probed in each, and the scale of a unit vector's projected coordinates in units of the
#: lattice. At a cosine of 0.93 a pair meets in one table with chance 0.66, so in one of four with 0.98.
TABLES, PROBES, SCALE = 4, 4, 0.7
#: Vectors in a cell beyond which it is cut into blocks that are compared two by two.
BLOCK = 2048


def _neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of +-1, or eight of +-1/2 with an even number of minus signs."""
    unit = np.eye(8)
    pairs = [s * unit[i] + t * unit[j] for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    halves = [np.array(h) for h in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in h) % 2 == 0]
    return np.array(pairs + halves)


NEIGHBOURS = _neighbours()


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum: round, and where the sum is odd round the worst the other way."""
    near = np.rint(x)
    off = x - near
    rows = np.flatnonzero(near.sum(1) % 2)
    worst = np.abs(off[rows]).argmax(1)
    near[rows, worst] += np.where(off[rows, worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: the closer one of its whole and its half-integer cosets."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.where(closer[:, None], whole, half)


def cells(units: np.ndarray, labels: list, seed: int, tables: int, probes: int, scale: float) -> np.ndarray:
    """Cell keys, rows x tables x (home, probes...)."""
    n, d = units.shape
    out = np.empty((n, tables, 1 + probes), np.int64)
    for t in range(tables):
        x = units @ (np.random.default_rng([seed, t, d]).normal(size=(d, 8)) * scale)
        home = decode(x)
        # the neighbour v nearest to x has the largest product with what is left of x; all are equally long
        order = np.argsort(-((x - home) @ NEIGHBOURS.T), axis=1, kind="stable")[:, :probes]
        points = np.concatenate([home[:, None], home[:, None] + NEIGHBOURS[order]], 1)
        points = np.ascontiguousarray((points * 2).astype(np.int32))
        for i in range(n):
            for k in range(1 + probes):
                out[i, t, k] = xxhash.xxh3_64_intdigest(points[i, k].tobytes() + f"{labels[i]} {d} {t}".encode()) - (1 << 63)
    return out


def units_of(vectors: list) -> np.ndarray:
    """Rows of one length scaled to length 1 in double precision, first by the largest part so that nothing overflows."""
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


_CELLS = "cell bigint, tab int, home boolean, rid bigint, m bigint, keys binary, unit binary"
_CELLS_ARROW = pa.schema(
    [("cell", pa.int64()), ("tab", pa.int32()), ("home", pa.bool_()), ("rid", pa.int64()), ("m", pa.int64()),
     ("keys", pa.binary()), ("unit", pa.binary())]
)


def _to_cells(seed: int, tables: int, probes: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 2000):
                rids, ms, labels, vectors = (c.to_pylist() for c in big.slice(at, 2000).columns)
                for size in sorted({len(v) for v in vectors}):
                    own = [i for i, v in enumerate(vectors) if len(v) == size]
                    units = units_of([vectors[i] for i in own])
                    keys = cells(units, [labels[i] for i in own], seed, tables, probes, scale)
                    n, per = len(own), tables * (1 + probes)
                    again = lambda values: [v for v in values for _ in range(per)]
                    yield pa.record_batch(
                        [pa.array(keys.ravel()), pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), 1 + probes), n)),
                         pa.array(np.tile(np.arange(1 + probes) == 0, n * tables)), pa.array(again(rids[i] for i in own), pa.int64()),
                         pa.array(again(ms[i] for i in own), pa.int64()), pa.array(again(k.tobytes() for k in keys), pa.binary()),
                         pa.array(again(u.tobytes() for u in units), pa.binary())], schema=_CELLS_ARROW)

    return run


def _met_before(ki: np.ndarray, kj: np.ndarray, tab: np.ndarray) -> np.ndarray:
    """Pairs that also meet in an earlier table."""
    met = (ki[:, :, :1] == kj).any(2) | (kj[:, :, :1] == ki).any(2)
    return (met & (np.arange(ki.shape[1])[None, :] < tab[:, None])).any(1)


def _links(table: dict[str, np.ndarray], group: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (i, j) that count here, among rows numbered by group; i is at home."""
    out_i, out_j = [], []
    cuts = np.flatnonzero(np.diff(group)) + 1
    starts, ends = np.append(0, cuts), np.append(cuts, len(group))
    home, part, unit, keys, tab, rid = (table[c] for c in ("home", "part", "unit", "keys", "tab", "rid"))

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        if not len(i):
            return
        flip = ~home[i]
        i, j = np.where(flip, j, i), np.where(flip, i, j)
        fresh = ~_met_before(keys[i], keys[j], tab[i])
        i, j = i[fresh], j[fresh]
        # where each probes the other's home, the pair meets in both cells: the smaller one's home counts
        twice = ~home[j] & (keys[i, tab[i], 1:] == keys[j, tab[j], :1]).any(1)
        ours = ~twice | (rid[i] < rid[j])
        out_i.append(i[ours])
        out_j.append(j[ours])

    small = [(a, b) for a, b in zip(starts, ends, strict=True) if 1 < b - a <= 64]
    for k in range(0, len(small), 400):
        i = np.concatenate([np.repeat(np.arange(a, b), b - a) for a, b in small[k : k + 400]])
        j = np.concatenate([np.tile(np.arange(a, b), b - a) for a, b in small[k : k + 400]])
        ok = (i < j) & (home[i] | home[j]) & ((part[i] != part[j]) | ~table["cross"][i])
        i, j = i[ok], j[ok]
        ok = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
        keep(i[ok], j[ok])
    for a, b in zip(starts, ends, strict=True):
        for c in range(a, b, 512) if b - a > 64 else ():
            stop = min(c + 512, b)
            i, j = np.nonzero(unit[c:stop] @ unit[a:b].T >= threshold)
            i, j = i + c, j + a
            ok = (i < j) & (home[i] | home[j]) & ((part[i] != part[j]) | ~table["cross"][i])
            keep(i[ok], j[ok])
    return np.concatenate([*out_i, np.empty(0, np.int64)]).astype(int), np.concatenate([*out_j, np.empty(0, np.int64)]).astype(int)


def _compare(threshold: float, tables: int, probes: int):
    schema = pa.schema([("rid", pa.int64()), ("n", pa.int64()), ("low", pa.int64())])

    def done(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        get = lambda c: t.column(c).to_numpy()
        # dimensions are part of the cell key, so a group has vectors of one length; groups of other lengths go apart
        sizes = np.array([len(u) for u in t.column("unit").to_pylist()])
        out = []
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            sub = t.take(pa.array(own))
            table = {c: sub.column(c).to_numpy() for c in ("rid", "m", "part", "cell", "a", "b")}
            table["tab"], table["home"] = sub.column("tab").to_numpy(), np.array(sub.column("home").to_pylist(), bool)
            table["cross"] = table["a"] != table["b"]
            table["unit"] = np.frombuffer(b"".join(sub.column("unit").to_pylist()), np.float64).reshape(len(own), -1)
            table["keys"] = np.frombuffer(b"".join(sub.column("keys").to_pylist()), np.int64).reshape(-1, tables, 1 + probes)
            change = np.any([np.diff(table[c]) != 0 for c in ("cell", "a", "b")], axis=0)
            i, j = _links(table, np.append(0, np.cumsum(change)), threshold)
            if not len(i):
                continue
            n = np.bincount(i, table["m"][j], len(own)) + np.bincount(j, table["m"][i], len(own))
            low = table["rid"].copy()
            while True:
                new = low.copy()
                np.minimum.at(new, i, low[j])
                np.minimum.at(new, j, low[i])
                if (new == low).all():
                    break
                low = new
            hit = np.unique(np.concatenate([i, j]))
            out.append((table["rid"][hit], n[hit].astype(np.int64), low[hit]))
        columns = [np.concatenate([o[k] for o in out]) if out else np.empty(0, np.int64) for k in range(3)]
        return pa.record_batch([pa.array(c) for c in columns], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # a group may go on in the next batch: what is before the last group can be done
            last = [batch.column(c)[batch.num_rows - 1].as_py() for c in ("cell", "a", "b")]
            same = np.all([batch.column(c).to_numpy() == x for c, x in zip(("cell", "a", "b"), last, strict=True)], axis=0)
            first = int(np.argmax(same))
            if first:
                yield done([*held, batch.slice(0, first)])
                held = []
            elif held and [held[-1].column(c)[held[-1].num_rows - 1].as_py() for c in ("cell", "a", "b")] != last:
                yield done(held)
                held = []
            held.append(batch.slice(first))
        if held:
            yield done(held)

    return run


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93,
    tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, block: int = BLOCK, seed: int = 11,
) -> DataFrame:
    """One row per vector: its id, n_links, component_id (smallest id reachable) and kept (whether that is its own).

    Vectors link when their labels are equal and their cosine is at least ``threshold``; equal vectors are compared
    once and counted as often as they occur. Vectors that are null, empty, zero or hold null or non-finite parts, and
    those without a label, link with nothing; vectors of different lengths do not link. A null id is kept, counts as a
    link, and never names a component unless all ids in it are null. Rows with one id are vectors of their own. Cells
    with more than ``block`` vectors are compared block by block, so no task holds a whole cell.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    fine = F.expr(
        "label IS NOT NULL AND vec IS NOT NULL AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) "
        "AND exists(vec, x -> x <> 0)"
    )
    fine = F.coalesce(fine, F.lit(False))
    reps = saved(
        rows.where(fine).groupBy("label", "vec").agg(F.min("id").alias("low_id"), F.count("*").alias("m"))
        .withColumn("rid", F.monotonically_increasing_id()), "vectors",
    )
    placed = reps.select("rid", "m", F.col("label").cast("string").alias("label"), "vec")
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = saved(placed.repartition(n, "rid").mapInArrow(_to_cells(seed, tables, probes, scale), _CELLS), "cells")
    hot = saved(
        placed.groupBy("cell").count().where(F.col("count") > block)
        .select("cell", F.ceil(F.col("count") / block).cast("int").alias("k")), "hot",
    )
    dealt = (
        joined_small(placed, hot, "cell").withColumn("k", F.coalesce("k", F.lit(1)))
        .withColumn("part", F.pmod(F.xxhash64("rid"), F.col("k")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .select("*", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b")).drop("k", "other")
    )
    found = saved(
        dealt.repartition(n, "cell", "a", "b").sortWithinPartitions("cell", "a", "b")
        .mapInArrow(_compare(threshold, tables, probes), "rid bigint, n bigint, low bigint"), "found",
    )
    counts = found.groupBy("rid").agg(F.sum("n").alias("n"))
    joined = components(reps.select(F.col("rid").alias("node")), found.select(F.col("rid").alias("a"), F.col("low").alias("b")))
    full = reps.join(counts, "rid", "left").join(joined.withColumnRenamed("node", "rid"), "rid")
    names = full.groupBy("component").agg(F.min("low_id").alias("component_id"))
    full = full.join(names, "component").select(
        "label", "vec", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id"
    )
    ids = rows.schema["id"].dataType
    known = rows.where(fine).join(full, ["label", "vec"]).select("id", "n_links", "component_id")
    alone = rows.where(~fine).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return known.union(alone).select(
        F.col("id").cast(ids if not isinstance(ids, T.NullType) else "bigint").alias(id_col), "n_links", "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
