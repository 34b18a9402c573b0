"""Batches of proposed changes: classify, normalize, select, stage, apply.

Changes are rows (change_id, kind, search, replace): a 'pair' replaces the entry its
``search`` names, an 'entry' stands for itself; both sides are field -> text.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.numbers import import_price, py_float
from ..functions.tags import fix_tier_tags
from ..functions.text import brand_fold, build_id, strip, text
from ..sources.catalog import clean_catalog
from . import links
from .claims import settle_ids
from .history import CHANGES, diff_op
from .spelling import canonical_spelling
from ..session import cut_lineage, spread
from .validate import with_row_errors


def _identity(get) -> Column:
    return F.struct(*[F.lower(strip(get(f))).alias(f) for f in ("brand", "model", "variant")])


def _list(c: Column) -> Column:
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def normalize_brands(changes: DataFrame, catalog: DataFrame) -> DataFrame:
    """Incoming brands in the catalog's spelling for the same fold."""
    canon = canonical_spelling(catalog, "brand").select(F.col("fold").alias("_fold"), "canonical")
    brand = strip(F.col("replace")["brand"])
    out = spread(changes).withColumn("_fold", brand_fold(brand)).join(canon, "_fold", "left")
    change = F.col("canonical").isNotNull() & (F.col("canonical") != brand) & (brand != "")
    return out.withColumn("replace", F.when(change, _put(F.col("replace"), "brand", F.col("canonical"))).otherwise(F.col("replace"))).select(
        *changes.columns
    )


def _put(m: Column, field: str, value: Column) -> Column:
    others = F.map_filter(m, lambda k, _: k != field)
    return F.map_concat(others, F.create_map(F.lit(field), value))


def normalize_prices(changes: DataFrame, fields=None) -> DataFrame:
    """Prices in whole $5 steps and the tier tag that goes with them, where selected."""
    out = changes
    has = F.col("replace").isNotNull()
    if fields is None or "price_usd" in fields:
        price = F.col("replace")["price_usd"]
        fixed = import_price(price)
        out = out.withColumn(
            "replace", F.when(has & price.isNotNull() & (fixed != price), _put(F.col("replace"), "price_usd", fixed)).otherwise(F.col("replace"))
        )
    if fields is None or "tags" in fields:
        raw = F.col("replace")["tags"]
        tags = _list(raw)
        price = F.coalesce(py_float(F.col("replace")["price_usd"]), F.lit(0.0))
        fixed = fix_tier_tags(tags, price)
        listed = raw.isNull() | F.from_json(raw, "array<string>").isNotNull()
        out = out.withColumn(
            "replace", F.when(has & listed & (fixed != tags), _put(F.col("replace"), "tags", F.to_json(fixed))).otherwise(F.col("replace"))
        )
    return out


def _differences(old: Column, new: Column) -> Column:
    out = []
    for f in S.FIELDS:
        if f in S.LIST_FIELDS:
            empty = F.array().cast("array<string>")
            before, after = F.coalesce(old[f], empty), _list(new[f])
            differs, o, n = before != after, F.to_json(before), F.to_json(after)
        else:
            o, n = old[f].cast("string"), new[f]
            differs = ~o.eqNullSafe(n)
        out.append(F.when(differs, F.struct(F.lit(f).alias("field"), o.alias("old"), n.alias("new"))))
    return F.array_compact(F.array(*out)).cast(CHANGES)


def classify_changes(catalog: DataFrame, changes: DataFrame) -> DataFrame:
    """Proposals: change_id, action (new|changed|delete|invalid), row_id, old, incoming, changes, error.

    A target is found by id, else by brand, model and variant without case; the first catalog
    row wins. Pairs claim before entries, in order, and a row takes one proposal. Pairs of
    equal content are dropped.
    """
    # the incoming batch as it is after normalizing: three lookups and the comparison read it
    changes = cut_lineage(changes)
    by_id = catalog.where("id <> ''").groupBy("id").agg(F.min("row_id").alias("row_id"))
    by_ident = catalog.groupBy(_identity(lambda f: F.col(f)).alias("ident")).agg(F.min("row_id").alias("row_id"))
    is_pair = F.col("kind") == "pair"
    named = F.when(is_pair, F.col("search")).otherwise(F.col("replace"))
    empty = F.coalesce(F.size(F.map_keys("replace")), F.lit(0)) <= 0
    c = (
        changes.where(is_pair | ~empty)
        .withColumn("named", named)
        .withColumn("_id", F.nullif(F.col("named")["id"], F.lit("")))
        .withColumn("_i1", _identity(lambda f: F.col("named")[f]))
        .withColumn("_i2", F.when(is_pair & ~empty, _identity(lambda f: F.col("replace")[f])))
    )
    found = (
        c.join(by_id.select(F.col("id").alias("_id"), F.col("row_id").alias("r0")), "_id", "left")
        .join(by_ident.select(F.col("ident").alias("_i1"), F.col("row_id").alias("r1")), "_i1", "left")
        .join(by_ident.select(F.col("ident").alias("_i2"), F.col("row_id").alias("r2")), "_i2", "left")
        .withColumn("row_id", F.coalesce("r0", "r1", "r2"))
        .withColumn("_turn", F.struct(F.when(is_pair, 0).otherwise(1).alias("k"), F.col("change_id").alias("c")))
    )
    claims = found.where("row_id IS NOT NULL").groupBy("row_id").agg(F.min("_turn").alias("_first"))
    entry = F.struct(*S.FIELDS)
    held = found.join(claims, "row_id", "left").join(catalog.select("row_id", entry.alias("old")), "row_id", "left")
    late = F.col("row_id").isNotNull() & (F.col("_turn") != F.col("_first"))
    unmatched = F.col("row_id").isNull()
    action = (
        F.when(unmatched & empty, "invalid")
        .when(unmatched, "new")
        .when(late, "invalid")
        .when(empty, "delete")
        .otherwise("changed")
    )
    error = F.when(unmatched & empty, F.lit("no entry matches")).when(late, F.lit("targeted more than once"))
    out = cut_lineage(held.withColumn("action", action)).withColumn(
        "changes", F.when(F.col("action") == "changed", _differences(F.col("old"), F.col("replace")))
    )
    return out.where("action <> 'changed' OR size(changes) > 0").select(
        "change_id", "kind", "action", "row_id",
        F.when(F.col("action").isin("changed", "delete"), F.col("old")).alias("old"),
        F.col("replace").alias("incoming"), "changes", error.alias("error"),
    )


def merge_fields(proposals: DataFrame, selection: DataFrame | None = None) -> DataFrame:
    """Proposals that go ahead, with ``fields``: null applies a row whole.

    selection(change_id, fields) names the fields kept per proposal. Without a selection row,
    new and changed apply whole, deletes and invalid ones do not.
    """
    if selection is None:
        return proposals.where(F.col("action").isin("new", "changed")).withColumn(
            "fields", F.lit(None).cast("array<string>")
        )
    picked = selection.select("change_id", F.col("fields").alias("fields"), F.lit(True).alias("_sel"))
    out = proposals.where("action <> 'invalid'").join(picked, "change_id", "left")
    known = F.when(
        F.col("action") == "changed", F.array_intersect("fields", F.transform("changes", lambda x: x["field"]))
    ).when(
        F.col("action") == "new", F.array_intersect("fields", F.array(*[F.lit(f) for f in S.FIELDS[1:]]))
    )
    out = out.withColumn("fields", F.when(F.col("fields").isNotNull(), known))
    default = F.col("_sel").isNull() & F.col("action").isin("new", "changed")
    keep = default | (F.col("_sel") & (F.col("fields").isNull() | (F.size("fields") > 0)))
    return out.where(keep).drop("_sel")


def _candidate(f: str) -> Column:
    old, new, fields = F.col("old")[f], F.col("incoming")[f], F.col("fields")
    old_text = F.coalesce(F.to_json(old) if f in S.LIST_FIELDS else old.cast("string"), F.lit(None).cast("string"))
    whole = F.col("fields").isNull()
    blank = F.lit("0" if f in S.INT_FIELDS else "[]" if f in S.LIST_FIELDS else "")
    chosen = F.array_contains(fields, f)
    return (
        F.when(whole, new)
        .when(F.col("action") == "changed", F.when(chosen, new).otherwise(old_text))
        .otherwise(F.when(chosen, new).otherwise(blank))
    )


def stage(proposals: DataFrame, catalog: DataFrame, files: DataFrame | None = None):
    """(staged, problems, stats): candidates that may be written, in text form per field.

    Links are kept when the incoming entry lists none, ids rebuilt, prices and tiers
    normalized, links to missing files removed, the result validated, and ids settled in
    order against the ids in use.
    """
    # one column per field, written out: every later step reads them several times
    writes = proposals.where("action <> 'delete'").select(
        "change_id", "action", "row_id", "fields", F.col("old")["id"].alias("old_id"),
        F.coalesce(F.col("old")["files"], F.array().cast("array<string>")).alias("old_files"),
        *[(_list(_candidate(f)) if f in S.LIST_FIELDS else _candidate(f)).alias(f) for f in S.FIELDS],
    )
    flat = cut_lineage(writes)

    def may(f):
        return F.col("fields").isNull() | F.array_contains("fields", f)

    # a missing or empty list of links never unlinks
    kept = (F.col("action") == "changed") & (F.size("files") == 0)
    want = build_id("brand", "model", "variant")
    fixed_price = import_price("price_usd")
    flat = (
        flat.withColumn("n_links_kept", F.when(kept, F.size("old_files")).otherwise(0))
        .withColumn("files", F.when(kept, F.col("old_files")).otherwise(F.col("files")))
        .withColumn("_want", want)
        .withColumn("id", F.when(F.col("_want") != "", F.col("_want")).otherwise(F.col("id")))
        .withColumn("_price", F.when(may("price_usd") & F.col("price_usd").isNotNull(), fixed_price).otherwise(F.col("price_usd")))
    )
    flat = flat.withColumn(
        "_tags", F.when(may("tags"), fix_tier_tags("tags", F.coalesce(py_float("_price"), F.lit(0.0)))).otherwise(F.col("tags"))
    )
    changed = ~F.col("_price").eqNullSafe(F.col("price_usd")) | (F.col("_tags") != F.col("tags"))
    flat = (
        flat.withColumn("was_fixed", changed)
        .withColumn("price_usd", F.col("_price"))
        .withColumn("tags", F.col("_tags"))
        .withColumn("n_phantoms", F.lit(0))
        .drop("_want", "_price", "_tags", "old_files")
    )
    if files is not None:
        linked = flat.where(may("files"))
        real = links.strip_phantom_files(linked, files, key="change_id")
        flat = flat.join(real, "change_id", "left")
        gone = F.coalesce(F.size("dropped"), F.lit(0))
        flat = flat.withColumn("n_phantoms", gone).withColumn(
            "files", F.when(F.col("n_phantoms") > 0, F.col("kept")).otherwise(F.col("files"))
        ).drop("kept", "dropped")

    judged = cut_lineage(with_row_errors(cut_lineage(flat), None, "_errors"))
    valid = judged.where("size(_errors) = 0")
    settled = settle_ids(
        valid.select(F.col("change_id").alias("seq"), F.when(F.col("action") == "changed", F.col("old_id")).alias("old_id"), F.col("id").alias("new_id")),
        catalog.where("id <> ''").select("id"),
    )
    taken = settled.where(~F.col("accepted")).select(F.col("seq").alias("change_id"), "new_id")
    ready = valid.join(taken.select("change_id"), "change_id", "left_anti")
    deletes = proposals.where("action = 'delete'").select(
        "change_id", "action", "row_id", F.col("old")["id"].alias("old_id"),
        *[F.lit(None).cast("array<string>" if f in S.LIST_FIELDS else "string").alias(f) for f in S.FIELDS],
    )
    staged = ready.select("change_id", "action", "row_id", "old_id", *S.FIELDS).unionByName(deletes)
    problems = judged.where("size(_errors) > 0").select("change_id", F.get("_errors", F.lit(0)).alias("error")).unionByName(
        taken.select("change_id", F.concat(F.lit("id is used by another entry: "), F.col("new_id")).alias("error"))
    )
    stats = judged.agg(
        F.count("*").alias("n_candidates"),
        F.count_if("was_fixed").alias("n_fixed"),
        F.sum("n_phantoms").alias("n_phantom_links"),
        F.count_if(F.col("n_links_kept") > 0).alias("n_links_kept"),
    )
    return staged, problems, stats


def import_stats(proposals: DataFrame) -> DataFrame:
    return proposals.groupBy("action").agg(F.count("*").alias("n"))


def clean_staged(staged: DataFrame) -> DataFrame:
    """Staged candidates with the catalog's types; numbering of new rows follows the catalog's."""
    entry = F.map_from_arrays(
        F.array(*[F.lit(f) for f in S.FIELDS]),
        F.array(*[F.to_json(f) if f in S.LIST_FIELDS else F.col(f) for f in S.FIELDS]),
    )
    writes = staged.where("action <> 'delete'").select(F.col("change_id").alias("row_id"), entry.alias("raw"))
    typed, _ = clean_catalog(writes, hints=False)
    return typed.withColumnRenamed("row_id", "change_id")


def apply_changes(catalog: DataFrame, staged: DataFrame, op_id: int = 1):
    """(catalog, change_log): changed rows replaced, deletes removed, new rows at the end.

    A delete whose row no longer carries the id it was proposed for is skipped.
    """
    typed = clean_staged(staged).join(staged.select("change_id", "action", "row_id"), "change_id")
    last = catalog.agg(F.coalesce(F.max("row_id"), F.lit(-1))).scalar()
    added = typed.where("action = 'new'").select((last + 1 + F.col("change_id")).cast("bigint").alias("row_id"), *S.FIELDS)
    changed = typed.where("action = 'changed'").select(F.col("row_id").cast("bigint").alias("row_id"), *S.FIELDS)
    doomed = staged.where("action = 'delete'").select("row_id", "old_id")
    removed = (
        catalog.select("row_id", "id").join(doomed, "row_id").where(text("id") == text("old_id")).select("row_id")
    )
    return upsert(catalog, changed.unionByName(added), removed, op_id)


def upsert(base: DataFrame, rows: DataFrame, removed: DataFrame, op_id: int = 1, key: str = "row_id"):
    """(table, change_log) after replacing or adding ``rows`` and dropping ``removed`` keys.

    Works on any keyed table. The log compares touched rows only.
    """
    fields = [c for c in base.columns]
    rows = rows.select(*fields).join(removed.select(key), key, "left_anti").select(*fields)
    touched = rows.select(key).unionByName(removed.select(key)).distinct()
    untouched = base.join(touched, key, "left_anti").select(*fields)
    log = diff_op(base.join(touched, key, "left_semi"), rows, key, op_id)
    return untouched.unionByName(rows), log
