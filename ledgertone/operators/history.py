"""Change logs: differences as data, undo, redo and the history listing.

A change log row is (op_id, key, action, changes, full_row). Edits hold only the fields that
differ, as text; adds and deletes hold the whole row as a struct.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHANGES = "array<struct<field:string,old:string,new:string>>"


def from_text(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.from_json(c, kind)
    return c if isinstance(kind, T.StringType) else c.cast(kind)


def diff_op(before: DataFrame, after: DataFrame, key: str = "row_id", op_id: int = 1) -> DataFrame:
    """The change log of one operation: one row per key that was added, deleted or edited."""
    fields = [f for f in before.columns if f != key]
    b = before.select(F.col(key), F.struct(*fields).alias("b"))
    a = after.select(F.col(key), F.struct(*fields).alias("a"))
    both = b.join(a, key, "full")

    def text_of(side, f):
        kind = before.schema[f].dataType
        nested = isinstance(kind, (T.ArrayType, T.MapType, T.StructType))
        return F.to_json(F.col(side)[f]) if nested else F.col(side)[f].cast("string")

    changes = F.array_compact(
        F.array(
            *[
                F.when(
                    ~F.col("b")[f].eqNullSafe(F.col("a")[f]),
                    F.struct(F.lit(f).alias("field"), text_of("b", f).alias("old"), text_of("a", f).alias("new")),
                )
                for f in fields
            ]
        )
    )
    action = (
        F.when(F.col("b").isNull(), "add").when(F.col("a").isNull(), "delete").otherwise("edit")
    )
    return (
        both.withColumn("action", action)
        .withColumn("changes", F.when(F.col("action") == "edit", changes))
        .where("action <> 'edit' OR size(changes) > 0")
        .select(
            F.lit(op_id).cast("bigint").alias("op_id"),
            key,
            "action",
            F.col("changes").cast(CHANGES).alias("changes"),
            F.when(F.col("action") == "add", F.col("a")).when(F.col("action") == "delete", F.col("b")).alias("full_row"),
        )
    )


def _replay(catalog: DataFrame, log: DataFrame, op_ids, key: str, undo: bool) -> DataFrame:
    """Net effect of undoing (or redoing) operations, one aggregation per key.

    Undo is decided by the earliest operation on a key, redo by the latest. A row that comes
    back starts from its stored copy; field edits on the near side of that copy apply on top.
    """
    fields = [f for f in catalog.columns if f != key]
    picked = log.where(F.col("op_id").isin([int(i) for i in op_ids]))
    order = F.col("op_id") if undo else -F.col("op_id")
    # the action that removes a row in this direction, and the one that brings it back
    removes, restores = ("add", "delete") if undo else ("delete", "add")
    per_key = picked.groupBy(key).agg(
        F.min_by("action", order).alias("decisive"),
        F.min(F.when(F.col("action") == restores, order)).alias("copy_at"),
        F.min_by(F.when(F.col("action") == restores, F.col("full_row")), F.when(F.col("action") == restores, order)).alias("copy"),
    )
    edits = (
        picked.where("action = 'edit'")
        .select(key, order.alias("o"), F.explode("changes").alias("c"))
        .join(per_key.select(key, "copy_at"), key)
        .where("copy_at IS NULL OR o < copy_at")
        .groupBy(key, F.col("c.field").alias("field"))
        .agg(F.min_by(F.struct(F.col("c.old" if undo else "c.new").alias("v")), "o").alias("s"))
        .groupBy(key)
        .agg(F.map_from_entries(F.collect_list(F.struct("field", "s.v"))).alias("edits"))
    )
    effect = per_key.join(edits, key, "left").withColumn("_touched", F.lit(True))
    live = catalog.select(key, F.struct(*fields).alias("live"))
    # a key only the log knows matters when it brings a row back
    both = live.join(effect, key, "full").where(
        (F.col("_touched").isNull() | (F.col("decisive") != removes))
        & (F.col("live").isNotNull() | F.col("copy").isNotNull())
    )
    base = F.coalesce("copy", "live")

    def value(f):
        kind = catalog.schema[f].dataType
        edited = F.map_contains_key("edits", F.lit(f))
        return F.when(F.coalesce(edited, F.lit(False)), from_text(F.col("edits")[f], kind)).otherwise(base[f]).alias(f)

    return both.select(*[F.col(key) if c == key else value(c) for c in catalog.columns])


def undo(catalog: DataFrame, log: DataFrame, op_ids, key: str = "row_id") -> DataFrame:
    return _replay(catalog, log, op_ids, key, undo=True)


def redo(catalog: DataFrame, log: DataFrame, op_ids, key: str = "row_id") -> DataFrame:
    return _replay(catalog, log, op_ids, key, undo=False)


def history_view(log: DataFrame, undone: DataFrame | None = None) -> DataFrame:
    """The listing, newest first: changes per operation, and whether it can be undone or redone.

    ``undone(op_id)`` names operations on the redo side.
    """
    ops = log.groupBy("op_id").agg(
        F.count("*").alias("n_changes"),
        F.count_if(F.col("action") == "add").alias("n_added"),
        F.count_if(F.col("action") == "edit").alias("n_edited"),
        F.count_if(F.col("action") == "delete").alias("n_deleted"),
    )
    if undone is not None:
        mark = undone.select("op_id", F.lit("redo").alias("state")).distinct()
        ops = ops.join(mark, "op_id", "left").withColumn("state", F.coalesce("state", F.lit("undo")))
    else:
        ops = ops.withColumn("state", F.lit("undo"))
    return ops.orderBy(F.desc("op_id"))


def from_full_copies(v1: DataFrame, key: str = "row_id") -> DataFrame:
    """Older logs (op_id, key, copy_before, copy_after) as field differences."""
    fields = v1.schema["copy_before"].dataType.names
    schema = v1.schema["copy_before"].dataType

    def text_of(side, f):
        nested = isinstance(schema[f].dataType, (T.ArrayType, T.MapType, T.StructType))
        return F.to_json(F.col(side)[f]) if nested else F.col(side)[f].cast("string")

    b, a = F.col("copy_before"), F.col("copy_after")
    changes = F.array_compact(
        F.array(
            *[
                F.when(
                    ~b[f].eqNullSafe(a[f]),
                    F.struct(F.lit(f).alias("field"), text_of("copy_before", f).alias("old"), text_of("copy_after", f).alias("new")),
                )
                for f in fields
            ]
        )
    )
    action = F.when(b.isNull(), "add").when(a.isNull(), "delete").otherwise("edit")
    return (
        v1.where(b.isNotNull() | a.isNotNull())
        .withColumn("action", action)
        .withColumn("changes", F.when(F.col("action") == "edit", changes).cast(CHANGES))
        .where("action <> 'edit' OR size(changes) > 0")
        .select("op_id", key, "action", "changes", F.when(F.col("action") == "add", a).when(F.col("action") == "delete", b).alias("full_row"))
    )
