"""Splitting ordered rows into chunks under a token budget."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..session import cut_lineage
from .lookup import catalog_order

MIN_BUDGET = 100


def token_estimate(c) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("bigint")


def entry_tokens() -> Column:
    """Tokens of a catalog entry written as indented JSON."""
    return token_estimate(F.to_json(F.struct(*S.FIELDS), {"pretty": "true", "ignoreNullFields": "false"}))


def _running_tokens(rows: DataFrame) -> DataFrame:
    """Adds ``s``, the tokens before each row of its group, for groups of any size.

    Rows are range partitioned by their order and written out, so the partition a row lies
    in is a fact and not recomputed. Partition totals are added up, then rows in partitions.
    """
    placed = cut_lineage(rows.repartitionByRange("g", "o").withColumn("p", F.spark_partition_id()))
    totals = placed.groupBy("g", "p").agg(F.sum("t").alias("t"))
    ahead = Window.partitionBy("g").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("g", "p", F.coalesce(F.sum("t").over(ahead), F.lit(0)).alias("off"))
    inside = Window.partitionBy("g", "p").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("_in", F.coalesce(F.sum("t").over(inside), F.lit(0)))
        .join(offsets, ["g", "p"])
        .select("g", "o", "t", (F.col("_in") + F.col("off")).cast("bigint").alias("s"))
    )


def _jumps(s: np.ndarray, end: np.ndarray, budget: int) -> np.ndarray:
    """Index of the first row of the next chunk when a chunk starts at each row."""
    nxt = np.searchsorted(end, s + budget, side="right")
    return np.maximum(nxt, np.arange(len(s)) + 1)


def _frame(group: str, size: int, **columns) -> pd.DataFrame:
    names = np.repeat(np.array([group], dtype=object), size)
    return pd.DataFrame({"g": pd.Series(names, dtype=object), **{k: np.asarray(v, dtype=np.int64) for k, v in columns.items()}})


def chunk_numbers(rows: DataFrame, budget: int, budgets_per_block: int = 256) -> DataFrame:
    """rows(g, o, t) with ``chunk``: exactly the greedy fill, one chunk after the other.

    Where a chunk may start depends on all chunks before it, but only through where the last
    one started. Groups are cut into blocks of many budgets; per block one task finds, for
    every row a chunk could enter the block at, where the next block is entered and how many
    chunks lie between. Those few edges are followed by pointer doubling, and each block then
    numbers its rows from its true entry.
    """
    span = budget * budgets_per_block
    rows = cut_lineage(_running_tokens(rows).withColumn("b", F.floor(F.col("s") / span).cast("bigint")))

    # each block also sees the rows of the next one that a chunk of its own can reach into
    near = rows.where((F.col("b") > 0) & (F.col("s") - F.col("b") * span <= budget))
    seen = rows.select("g", "b", "s", "t", F.lit(False).alias("halo")).unionByName(
        near.select("g", (F.col("b") - 1).alias("b"), "s", "t", F.lit(True).alias("halo"))
    )

    def edges(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("s")
        s, t, halo = pdf["s"].to_numpy(), pdf["t"].to_numpy(), pdf["halo"].to_numpy()
        own = int((~halo).sum())
        if own == 0:
            return _frame(pdf["g"].iloc[0], 0, b=[], entry=[], exit=[], n=[])
        block = int(pdf["b"].iloc[0])
        end = s + t
        nxt = _jumps(s, end, budget)
        last, count = np.empty(own, dtype=np.int64), np.empty(own, dtype=np.int64)
        for i in range(own - 1, -1, -1):
            j = nxt[i]
            last[i], count[i] = (j, 1) if j >= own else (last[j], count[j] + 1)
        # without a row beyond, the next chunk starts where this block's rows end
        follows = np.where(last < len(s), s[np.minimum(last, len(s) - 1)], end[own - 1])
        entry = np.nonzero(s[:own] - block * span <= budget)[0]
        if len(entry) == 0 or entry[0] != 0:
            entry = np.concatenate([[0], entry])
        return _frame(
            pdf["g"].iloc[0], len(entry), b=np.full(len(entry), block), entry=s[entry], exit=follows[entry], n=count[entry]
        )

    key = rows.schema["g"].dataType.simpleString()
    steps = cut_lineage(
        seen.groupBy("g", "b").applyInPandas(edges, f"g {key}, b bigint, entry bigint, exit bigint, n bigint")
    )
    depth = steps.groupBy("g").agg(F.count_distinct("b").alias("k")).agg(F.max("k")).first()[0] or 1

    # entries reached from the start of each group, with the chunks opened before them
    reached = steps.where("entry = 0").select("g", "entry", F.lit(0).cast("bigint").alias("before"))
    jump = steps.select("g", "entry", "exit", "n")
    for _ in range(math.ceil(math.log2(depth)) if depth > 1 else 0):
        hop = jump.select("g", "entry", F.col("exit").alias("_to"), F.col("n").alias("_n"))
        onward = reached.join(hop, ["g", "entry"]).select(
            "g", F.col("_to").alias("entry"), (F.col("before") + F.col("_n")).alias("before")
        )
        reached = cut_lineage(reached.unionByName(onward).distinct())
        second = jump.select("g", F.col("entry").alias("exit"), F.col("exit").alias("_to"), F.col("n").alias("_m"))
        jump = cut_lineage(
            jump.join(second, ["g", "exit"]).select("g", "entry", F.col("_to").alias("exit"), (F.col("n") + F.col("_m")).alias("n"))
        )
    starts = steps.select("g", "b", "entry").join(reached, ["g", "entry"])
    blocks = rows.join(starts, ["g", "b"], "left")
    # a last block that lies wholly inside the chunk before it has no entry of its own
    total = reached.join(steps, ["g", "entry"]).groupBy("g").agg(F.max(F.col("before") + F.col("n")).alias("all"))
    blocks = blocks.join(total, "g")

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("s")
        s, end = pdf["s"].to_numpy(), (pdf["s"] + pdf["t"]).to_numpy()
        chunk = np.zeros(len(s), dtype=np.int64)
        if pd.isna(pdf["entry"].iloc[0]):
            chunk[:] = int(pdf["all"].iloc[0])
        else:
            before = int(pdf["before"].iloc[0])
            i = int(np.searchsorted(s, int(pdf["entry"].iloc[0])))
            chunk[:i] = before
            nxt = _jumps(s, end, budget)
            while i < len(s):
                before += 1
                chunk[i : nxt[i]] = before
                i = nxt[i]
        return _frame(pdf["g"].iloc[0], len(s), s=s, chunk=chunk)

    numbered = blocks.select("g", "b", "s", "t", "entry", "before", "all").groupBy("g", "b").applyInPandas(
        number, f"g {key}, s bigint, chunk bigint"
    )
    return rows.join(numbered, ["g", "s"]).select("g", "o", "t", "chunk")


def chunk_by_tokens(df: DataFrame, tokens: Column, order_cols, row: str = "row_id", group_cols=(),
                    max_tokens: int = 50_000, budgets_per_block: int = 256) -> DataFrame:
    """The input with ``tokens`` and ``chunk`` (from 1 in each group), filled greedily in order.

    A chunk closes when the next row would exceed the budget; a row above the budget is a
    chunk of its own.
    """
    if max_tokens < MIN_BUDGET:
        raise ValueError(f"the budget is at least {MIN_BUDGET} tokens")
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    group = F.struct(*group_cols) if group_cols else F.struct(F.lit(0).alias("all"))
    sized = df.withColumn("tokens", tokens)
    slim = sized.select(
        F.to_json(group).alias("g"),
        F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], F.col(row).alias("row")).alias("o"),
        F.col("tokens").alias("t"),
    )
    numbers = chunk_numbers(slim, max_tokens, budgets_per_block).select(F.col("o.row").alias(row), "chunk")
    return sized.join(numbers, row)


def chunk_catalog(catalog: DataFrame, max_tokens: int = 50_000) -> DataFrame:
    return chunk_by_tokens(catalog, entry_tokens(), catalog_order(), max_tokens=max_tokens)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One folder per chunk, rows as JSON lines in catalog order."""
    chunks.repartition("chunk").sortWithinPartitions("chunk", *catalog_order()).write.mode("overwrite").partitionBy(
        "chunk"
    ).json(path)
