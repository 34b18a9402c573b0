"""Merkle manifests of a table: digests of rows, trees per group, one root, proofs and their verification.

Rows of a group are numbered without gaps, and up to ARITY consecutive nodes become one parent. On every level a window
over the nodes' numbers gives each node its neighbours at fixed distances (``lag`` and ``lead`` by 1 to ARITY - 1); its
slot and the length of its run tell which of them are siblings. The first child of a run holds all others to its right,
so its row makes the parent. Windows cover blocks of BLOCK consecutive nodes, never a whole group: a run never crosses
a block, so a group with a third of all rows is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

ARITY = 16
#: Nodes in a window, a multiple of ARITY.
BLOCK = ARITY**2

PATH = "array<struct<l:string,r:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the concatenated texts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field_text(col: str | Column) -> Column:
    """A value so that no two rows read alike: UTF-8 byte count, colon, value; a dash for null."""
    text = (F.col(col) if isinstance(col, str) else col).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*cols: str | Column) -> Column:
    return digest(*[field_text(c) for c in cols])


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The rows with ``i``, their number in the group from 0 in the given order, and ``n``, the group's size.

    Rows are dealt by ranges of (group, order), saved, numbered within each range, and the sizes of a group's earlier
    ranges are added. Rows equal in all order columns are split as well; their order among each other is any.
    """
    dealt = rows.withColumn("_u", F.monotonically_increasing_id()).repartitionByRange(group, *order, "_u")
    kept = saved(dealt.withColumn("_part", F.spark_partition_id()), "dealt")
    sizes = kept.groupBy(group, "_part").agg(F.count("*").alias("_rows"))
    # a group has at most one row per range here
    every = Window.partitionBy(group)
    earlier = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        group, "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"), F.sum("_rows").over(every).alias("n")
    )
    within = Window.partitionBy(group, "_part").orderBy(*order, "_u")
    out = kept.join(offsets, [group, "_part"]).withColumn("i", F.col("_before") + F.row_number().over(within) - 1)
    return out.drop("_u", "_part", "_before")


def _with_siblings(nodes: DataFrame) -> DataFrame:
    """Nodes (g, i, n, h, ...) with ``l`` and ``r``: the siblings' digests left and right of each, concatenated in order."""
    over = Window.partitionBy("g", "_block").orderBy("i")
    slot = F.col("i") % ARITY
    run = F.least(F.lit(ARITY), F.col("n") - (F.col("i") - slot))
    near = lambda fn, k, held: F.coalesce(F.when(held, fn("h", k).over(over)), F.lit(""))
    return (
        nodes.withColumn("_block", F.expr(f"i div {BLOCK}"))
        .withColumn("l", F.concat(*[near(F.lag, k, slot >= k) for k in range(ARITY - 1, 0, -1)]))
        .withColumn("r", F.concat(*[near(F.lead, k, slot + k < run) for k in range(1, ARITY)]))
        .drop("_block")
    )


def _parents(nodes: DataFrame) -> DataFrame:
    """The level above: one node per run, made in the row of its first child; groups of one node are at their top."""
    first = _with_siblings(nodes.select("g", "i", "n", "h").where("n > 1")).where(F.col("i") % ARITY == 0)
    return first.select(
        "g", F.expr(f"i div {ARITY}").alias("i"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"), digest(F.col("h"), F.col("r")).alias("h")
    )


def _levels(leaves: DataFrame, most: int) -> list[DataFrame]:
    """Levels from the leaves up to where the largest group, of ``most`` nodes, has one node."""
    out = [leaves]
    while most > 1:
        out.append(saved(_parents(out[-1]), "level"))
        most = -(-most // ARITY)
    return out


def _down(levels: list[DataFrame], tops: DataFrame, keep: list[str]) -> DataFrame:
    """The lowest level's nodes with ``path``, siblings level by level up to what ``tops`` (g, path, keep) holds."""
    above = None
    for k, level in reversed(list(enumerate(levels))):
        nodes = _with_siblings(level)
        carry = [c for c in level.columns if c not in ("n", "h")] if k == 0 else ["g", "i"]
        # groups that end on this level hang under their top, the others under their parents
        ends = level.where("n = 1").select("g").join(tops, "g").select("g", F.lit(0).cast("bigint").alias("p"), "path", *keep)
        under = ends if above is None else above.select("g", F.col("i").alias("p"), "path", *keep).union(ends)
        step = F.array(F.struct("l", "r"))
        found = nodes.withColumn("p", F.expr(f"i div {ARITY}")).join(under, ["g", "p"])
        above = found.select(
            *[c for c in carry], *(["h"] if k == 0 else []),
            F.when(F.col("n") > 1, F.concat(step, "path")).otherwise(F.col("path")).alias("path"), *keep,
        )
    return above


def manifest(rows: DataFrame, leaf_col: str = "leaf", id_col: str = "doc_id", group_col: str = "source") -> DataFrame:
    """The rows with ``subroot`` (of their group), ``root`` and ``path``, an array of (l, r) for each level from the leaf up.

    Leaves of a group ascend by id (null first; equal ids by leaf), groups by their text's bytes (null first). While
    more than one node remains, every ARITY consecutive ones become the digest of their concatenation; the groups'
    last nodes give the root in the same way. A lone leaf is its group's subroot, a lone subroot the root. Repeated
    rows are leaves of their own. An empty table gives an empty result. Columns named as the new ones are replaced.
    """
    made = {"subroot", "root", "path"}
    names = [c for c in rows.columns if c.lower() not in made]
    group = F.col(group_col).cast("string")
    # one key that is never null and sorts null first
    flat = rows.select(
        F.struct(*names).alias("row"), F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("g"), F.col(id_col).alias("id"), F.col(leaf_col).alias("h")
    )
    leaves = saved(numbered(flat, "g", ["id", "h"]).drop("id"), "leaves")
    most, groups = leaves.agg(F.max("n"), F.count_distinct("g")).first()
    if not most:
        return rows.select(*names, F.lit("").alias("subroot"), F.lit("").alias("root"), F.expr(f"CAST(NULL AS {PATH})").alias("path"))
    levels = _levels(leaves, most)
    subroots = levels[0].where("n = 1").select("g", "h")
    for level in levels[1:]:
        subroots = subroots.union(level.where("n = 1").select("g", "h"))
    ranked = numbered(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "h"), "g", ["name"])
    upper = _levels(saved(ranked.select("g", "name", "i", "n", "h"), "subroots"), groups)
    root = upper[-1].where("n = 1").select("g", F.expr(f"CAST(array() AS {PATH})").alias("path"), F.col("h").alias("root"))
    tops = saved(
        _down(upper, root, ["root"]).select(F.col("name").alias("g"), "path", F.col("h").alias("subroot"), "root"), "tops"
    )
    out = _down(levels, tops, ["subroot", "root"])
    return out.select(*[F.col("row")[c].alias(c) for c in names], "subroot", "root", "path")


def proof_digest(path: str = "path") -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""))


def fold(leaf: str | Column, path: str = "path") -> Column:
    """The root that a leaf and its siblings give."""
    start = F.col(leaf) if isinstance(leaf, str) else leaf
    return F.aggregate(path, start, lambda h, s: digest(s["l"], h, s["r"]))
