"""Applying the fixes an audit computed."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from .claims import settle_ids
from .history import diff_op, from_text
from .issues import waive
from ..session import cut_lineage
from .validate import with_row_errors


def apply_fixes(catalog: DataFrame, issues: DataFrame, waivers: DataFrame | None = None, op_id: int = 1,
                last_year: int | None = None):
    """(catalog, change_log, rejected): fixes of live issues, in issue order, last writer wins.

    A fix that would give a row an id another row holds is refused, and the row's other fixes stand. A row that was
    valid and would no longer be stays as it was. ``rejected`` names row, fix (null: all of them) and reason.
    """
    live = issues if waivers is None else waive(issues, waivers)
    writes = cut_lineage(
        live.where("fix IS NOT NULL AND row_id IS NOT NULL")
        .select("row_id", "fix_order", F.explode("fix").alias("f"))
        .select("row_id", "fix_order", "f.field", "f.pos", "f.value", "f.items")
    )
    # fixes that change ids, one rule after the other, each in row order
    ids = catalog.select("row_id", "id")
    refused = writes.select("row_id", "fix_order", F.col("value").alias("new_id")).where(F.lit(False))
    naming = writes.where("field = 'id'").select("row_id", "fix_order", F.col("value").alias("new_id"))
    for order in sorted(r[0] for r in naming.select("fix_order").distinct().collect()):  # one row per rule
        asked = naming.where(F.col("fix_order") == order).groupBy("row_id").agg(F.max("new_id").alias("new_id")).join(ids, "row_id")
        settled = settle_ids(
            asked.select(F.col("row_id").alias("seq"), F.col("id").alias("old_id"), "new_id"), ids.where("id <> ''"), by="holders"
        ).select(F.col("seq").alias("row_id"), "new_id", "accepted")
        settled = cut_lineage(settled)
        refused = refused.unionByName(settled.where("NOT accepted").select("row_id", F.lit(order).alias("fix_order"), "new_id"))
        given = settled.where("accepted").select("row_id", "new_id")
        ids = cut_lineage(ids.join(given, "row_id", "left").select("row_id", F.coalesce("new_id", "id").alias("id")))
    refused = cut_lineage(refused)
    writes = writes.join(refused.select("row_id", "fix_order"), ["row_id", "fix_order"], "left_anti")
    # scalars and whole lists: the last write of a field; list elements: the first per place
    per_field = (
        writes.where("pos IS NULL")
        .groupBy("row_id", "field")
        .agg(F.max_by(F.struct("value", "items"), "fix_order").alias("w"))
        .groupBy("row_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("field", "w"))).alias("writes"))
    )
    per_place = (
        writes.where("pos IS NOT NULL")
        .groupBy("row_id", "pos")
        .agg(F.min_by(F.struct("value"), F.struct("fix_order", "value")).alias("w"))
        .groupBy("row_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("pos", "w"))).alias("places"))
    )
    touched = catalog.join(per_field, "row_id", "left").join(per_place, "row_id", "left").where(
        "writes IS NOT NULL OR places IS NOT NULL"
    )

    def written(f):
        kind = catalog.schema[f].dataType
        hit = F.coalesce(F.map_contains_key("writes", F.lit(f)), F.lit(False))
        w = F.col("writes")[f]
        if f in S.LIST_FIELDS:
            out = F.when(hit, w["items"]).otherwise(F.col(f))
        else:
            out = F.when(hit, from_text(w["value"], kind)).otherwise(F.col(f))
        if f == "files":
            moved = F.filter(
                F.transform(
                    F.col(f),
                    lambda x, i: F.when(
                        F.coalesce(F.map_contains_key("places", i), F.lit(False)), F.col("places")[i]["value"]
                    ).otherwise(x),
                ),
                lambda x: x.isNotNull(),
            )
            out = F.when(F.col("places").isNotNull(), moved).otherwise(out)
        return out.alias(f)

    fields = [c for c in catalog.columns if c != "row_id"]
    # read by both validations and the log
    after = cut_lineage(touched.select("row_id", *[written(f) for f in fields]))

    was = with_row_errors(catalog.join(after.select("row_id"), "row_id", "left_semi"), last_year, "_was")
    now = with_row_errors(after, last_year, "_now")
    judged = cut_lineage(now.join(was.select("row_id", F.size("_was").alias("_was")), "row_id"))
    worse = (F.col("_was") == 0) & (F.size("_now") > 0)
    broken = judged.where(worse).select(
        "row_id", F.lit(None).cast("int").alias("fix_order"),
        F.concat(F.lit("would become invalid: "), F.get("_now", F.lit(0))).alias("reason"),
    )
    taken = refused.select(
        "row_id", F.col("fix_order").cast("int").alias("fix_order"), F.concat(F.lit("id is taken: "), F.col("new_id")).alias("reason")
    )
    kept = judged.where(~worse).select("row_id", *fields)

    rest = catalog.join(kept.select("row_id"), "row_id", "left_anti")
    log = diff_op(catalog.join(kept.select("row_id"), "row_id", "left_semi"), kept, "row_id", op_id)
    return rest.unionByName(kept), log, taken.unionByName(broken)
