"""Undo and redo stacks of long histories, without walking a history in one task.

The two stacks of a history are one line of operations with a cursor: those before it can be undone, those after it redone.
A block of actions maps each pair (cursor, length) to another, so blocks are evaluated side by side for all pairs, their maps
are composed up a tree of bounded fan-out, and the true pair of each block comes back down. A new operation cuts the line
at its place, so an operation is left if no later one took its place or one before it: a suffix minimum over blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

#: Operations that a history keeps.
KEEP = 200
#: Actions of a block, and blocks whose maps are composed in one task.
BLOCK, FAN = 8192, 128
DO, UNDO, REDO = 0, 1, 2


def _pairs(keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Cursor and length of every state; state number = length * (length + 1) / 2 + cursor."""
    length = np.repeat(np.arange(keep + 1), np.arange(1, keep + 2))
    return np.arange(len(length)) - length * (length + 1) // 2, length


def block_map(kinds: np.ndarray, keep: int) -> np.ndarray:
    """The state after the actions for each state before them."""
    cursors, lengths = _pairs(keep)
    at, (c, n) = np.arange(len(cursors)), (cursors, lengths)
    for i, kind in enumerate(kinds):
        if kind == DO:
            n = c = np.minimum(c + 1, keep)
        elif kind == UNDO:
            c = np.maximum(c - 1, 0)
        else:
            c = np.minimum(c + 1, n)
        if i % 16 == 15:  # states that have met stay together
            left, back = np.unique(n * (n + 1) // 2 + c, return_inverse=True)
            at, c, n = back[at], cursors[left], lengths[left]
    return (n * (n + 1) // 2 + c)[at].astype(np.int32)


def walk(kinds: np.ndarray, seqs: np.ndarray, state: int, keep: int) -> tuple[int, int | None, int, list[int], list[int]]:
    """(operations dropped, lowest place taken, cursor, seqs, places) of a block; places count from the oldest kept before it."""
    cursors, lengths = _pairs(keep)
    c, n, dropped, low = int(cursors[state]), int(lengths[state]), 0, None
    line: list[tuple[int, int]] = []
    for kind, seq in zip(kinds.tolist(), seqs.tolist(), strict=True):
        if kind == DO:
            dropped += c == keep
            n = c = min(c + 1, keep)
            place = dropped + c
            low = place if low is None else min(low, place)
            while line and line[-1][0] >= place:
                line.pop()
            line.append((place, seq))
        elif kind == UNDO:
            c = max(c - 1, 0)
        else:
            c = min(c + 1, n)
    line = [x for x in line if x[0] > dropped]
    return dropped, low, c, [s for _, s in line], [p for p, _ in line]


def _cut(keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            history, kinds, seqs = batch.column("history"), batch.column("kind").to_numpy(), batch.column("seq").to_numpy()
            codes = history.dictionary_encode("encode").indices.to_numpy()
            starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else []
            runs = zip(starts, [*starts[1:], len(codes)], strict=True)
            # a short run inside a batch is a whole history and starts from nothing: it needs no map
            parts = [(x, min(x + BLOCK, b), 0 < a and b < len(codes) and b - a <= BLOCK) for a, b in runs for x in range(a, b, BLOCK)]
            yield pa.RecordBatch.from_arrays(
                [
                    history.take(pa.array([a for a, _, _ in parts], pa.int64())),
                    pa.array([seqs[a:b].astype(np.int64).tobytes() for a, b, _ in parts], pa.binary()),
                    pa.array([kinds[a:b].astype(np.uint8).tobytes() for a, b, _ in parts], pa.binary()),
                    pa.array([None if whole else block_map(kinds[a:b], keep).tobytes() for a, b, whole in parts], pa.binary()),
                ],
                names=["history", "seqs", "kinds", "map"],
            )

    return run


def _compose(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("n")
    made = np.frombuffer(rows["map"].iloc[0], np.int32)
    for raw in rows["map"].iloc[1:]:
        made = np.frombuffer(raw, np.int32)[made]
    return pd.DataFrame({"history": rows["history"].iloc[:1], "n": rows["up"].iloc[:1], "map": [made.tobytes()]})


def _enter(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("n")
    states = [int(rows["state"].iloc[0])]
    for raw in rows["map"].iloc[:-1]:
        states.append(int(np.frombuffer(raw, np.int32)[states[-1]]))
    return pd.DataFrame({"history": rows["history"], "n": rows["n"], "state": states})


def _walks(keep: int):
    names = ["history", "at", "dropped", "low", "cursor", "seqs", "places"]
    kinds = [None, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                walk(np.frombuffer(k, np.uint8), np.frombuffer(s, np.int64), state, keep)
                for k, s, state in zip(*(batch.column(c).to_pylist() for c in ("kinds", "seqs", "state")), strict=True)
            ]
            made = [pa.array([f[i] for f in found], kinds[i + 2]) for i in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column("history"), batch.column("at"), *made], names=names)

    return run


def live_operations(actions: DataFrame, history: str = "history", seq: str = "seq", action: str = "action", keep: int = KEEP) -> DataFrame:
    """(history, seq, state) of the operations that a history's actions leave: 'undo' if it can be undone, 'redo' if redone.

    Actions are 'do', 'undo' and 'redo', in the order of ``seq`` (a whole number; of equal ones do, undo, redo). A new operation
    clears what could be redone, the oldest beyond ``keep`` go; undo or redo of nothing does nothing. Rows without a
    seq or with another action are passed over; rows without a history are one history. Other columns are ignored.
    """
    kind = F.when(F.col(action) == "do", DO).when(F.col(action) == "undo", UNDO).when(F.col(action) == "redo", REDO)
    rows = actions.select(F.col(history).alias("history"), F.col(seq).cast("bigint").alias("seq"), kind.cast("int").alias("kind"))
    rows = rows.where("seq IS NOT NULL AND kind IS NOT NULL").repartitionByRange("history", "seq").sortWithinPartitions("history", "seq", "kind")
    own = rows.schema["history"]
    made = rows.mapInArrow(_cut(keep), T.StructType([own, *T._parse_datatype_string("seqs binary, kinds binary, map binary").fields]))
    # partitions follow the order, so the numbers do too
    blocks = written(made.withColumn("at", F.monotonically_increasing_id()))
    order = Window.partitionBy("history").orderBy("at")  # one small row per block
    numbered = written(blocks.select("history", "at").withColumn("n", F.row_number().over(order) - 1))
    levels = [written(blocks.where("map IS NOT NULL").select("at", "map").join(numbered, "at").select("history", F.col("n").cast("bigint"), "map"))]
    up = (F.col("n") / FAN).cast("bigint")
    while (levels[-1].agg(F.max("n")).first()[0] or 0) >= FAN:
        level = levels[-1].withColumn("up", up)
        levels.append(written(level.groupBy("history", "up").applyInPandas(_compose, levels[0].schema)))
    entered = T.StructType([own, *T._parse_datatype_string("n bigint, state int").fields])
    states = None
    for level in reversed(levels):
        level = level.withColumn("up", up)
        if states is None:
            level = level.withColumn("state", F.lit(0))
        else:
            above = states.select(F.col("history").alias("h"), F.col("n").alias("above"), "state")
            level = level.join(above, F.col("history").eqNullSafe(F.col("h")) & (F.col("up") == F.col("above"))).drop("h", "above")
        states = written(level.groupBy("history", "up").applyInPandas(_enter, entered))
    known = states.select(F.col("history").alias("h"), F.col("n").alias("m"), "state")
    known = numbered.join(known, F.col("history").eqNullSafe(F.col("h")) & (F.col("n") == F.col("m")), "left")
    known = known.select("at", F.coalesce("state", F.lit(0)).alias("state"))
    fields = [own, *T._parse_datatype_string("at bigint, dropped bigint, low bigint, cursor bigint, seqs array<bigint>, places array<bigint>").fields]
    walked = written(blocks.drop("map").join(known, "at").mapInArrow(_walks(keep), T.StructType(fields)))
    whole = Window.partitionBy("history")
    places = (
        walked.select("history", "at", "dropped", "low", "cursor")
        .withColumn("before", F.sum("dropped").over(order) - F.col("dropped"))
        .withColumn("total", F.sum("dropped").over(whole))
        .withColumn("end", F.max_by("cursor", "at").over(whole))
        .withColumn("next", F.min(F.col("before") + F.col("low")).over(order.rowsBetween(1, Window.unboundedFollowing)))
        .select("at", "before", "total", "end", "next")
    )
    one = walked.select("history", "at", F.explode(F.arrays_zip("seqs", "places")).alias("o")).join(places, "at")
    place = F.col("before") + F.col("o.places")
    return one.where((place > F.col("total")) & (F.col("next").isNull() | (place < F.col("next")))).select(
        "history", F.col("o.seqs").alias("seq"), F.when(place <= F.col("total") + F.col("end"), "undo").otherwise("redo").alias("state")
    )
