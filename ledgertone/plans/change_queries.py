"""Change batches, upserts, change logs and reply documents over the driver tables."""

from pyspark.sql import functions as F

from .. import schema as S
from ..operators import changes as C
from ..operators import edits as E
from ..operators import history as H
from ..operators.convert import link_files
from ..operators.merge import merge_pair
from ..operators.stacks import KEEP, live_operations
from ..session import written
from ..sources.change_docs import ingest_change_docs
from .base import ORACLES, columns, query, show_list, spark_sql, table
from .catalog_queries import CAT, LAST_YEAR, disk_files, part_catalog

# every part proposes a change: entries by id, deletions, unknown products, and second proposals
CHANGES = """SELECT row_id * 2 AS change_id, CASE WHEN row_id % 4 IN (1, 3) THEN 'pair' ELSE 'entry' END AS kind,
  CASE WHEN row_id % 4 IN (1, 3) THEN id END AS s_id, CASE WHEN row_id % 4 IN (1, 3) THEN upper(model) END AS s_model,
  CASE WHEN row_id % 4 IN (1, 3) THEN brand END AS s_brand, CASE WHEN row_id % 4 IN (1, 3) THEN variant END AS s_variant,
  row_id % 8 <> 1 AS has_r,
  CASE WHEN row_id % 4 = 2 THEN 'nowhere_' || row_id ELSE id END AS r_id, brand AS r_brand,
  CASE WHEN row_id % 4 = 2 THEN model || ' zz' ELSE model END AS r_model, variant AS r_variant,
  CAST(price_usd + row_id % 3 AS STRING) AS r_price FROM cat
UNION ALL SELECT row_id * 2 + 1, 'entry', NULL, NULL, NULL, NULL, true, id, lower(brand), model, variant, '500' FROM cat WHERE row_id % 12 = 0"""
INCOMING = ("id", "brand", "model", "variant", "price_usd")


def part_changes(spark, sf):
    catalog = part_catalog(spark, sf)
    raw = spark.sql(CHANGES.replace("FROM cat", "FROM {cat}"), cat=catalog)
    search = F.create_map(*[x for f in ("id", "model", "brand", "variant") for x in (F.lit(f), F.col(f"s_{f}"))])
    names = dict(zip(INCOMING, ("r_id", "r_brand", "r_model", "r_variant", "r_price")))
    replace = F.create_map(*[x for f, c in names.items() for x in (F.lit(f), F.col(c))])
    return raw.select(
        "change_id", "kind", F.when(F.col("kind") == "pair", search).alias("search"), F.when(F.col("has_r"), replace).alias("replace")
    )


LISTED = ", ".join(
    f"CASE WHEN c.{f} <> p.r_{f.split('_')[0]} THEN '{f}' END" if f in INCOMING
    else f"CASE WHEN len(c.{f}) > 0 THEN '{f}' END" if f in S.LIST_FIELDS
    else f"'{f}'"
    for f in S.FIELDS
).replace("c.price_usd", "CAST(c.price_usd AS VARCHAR)")


@query("classify_changes", f"""WITH {CAT}, ch AS ({CHANGES.replace('STRING', 'VARCHAR')}),
bi AS (SELECT id, min(row_id) AS r FROM cat WHERE id <> '' GROUP BY 1),
bn AS (SELECT lower(trim(brand)) AS b, lower(trim(model)) AS m, lower(trim(variant)) AS v, min(row_id) AS r FROM cat GROUP BY 1, 2, 3),
t AS (SELECT ch.*, coalesce(bi.r, b1.r, b2.r) AS row_id FROM ch
  LEFT JOIN bi ON bi.id = CASE WHEN kind = 'pair' THEN s_id ELSE r_id END
  LEFT JOIN bn b1 ON b1.b = lower(trim(CASE WHEN kind = 'pair' THEN s_brand ELSE r_brand END))
    AND b1.m = lower(trim(CASE WHEN kind = 'pair' THEN s_model ELSE r_model END)) AND b1.v = lower(trim(CASE WHEN kind = 'pair' THEN s_variant ELSE r_variant END))
  LEFT JOIN bn b2 ON kind = 'pair' AND has_r AND b2.b = lower(trim(r_brand)) AND b2.m = lower(trim(r_model)) AND b2.v = lower(trim(r_variant))),
q AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY CASE kind WHEN 'pair' THEN 0 ELSE 1 END, change_id) AS turn FROM t),
a AS (SELECT *, CASE WHEN row_id IS NULL THEN CASE WHEN has_r THEN 'new' ELSE 'invalid' END WHEN turn > 1 THEN 'invalid' WHEN NOT has_r THEN 'delete' ELSE 'changed' END AS action FROM q)
SELECT p.change_id, p.action, p.row_id, CASE WHEN p.action = 'changed' THEN array_to_string(list_filter([{LISTED}], lambda x: x IS NOT NULL), ',') ELSE '' END AS fields,
  CASE WHEN p.action = 'invalid' THEN CASE WHEN p.row_id IS NULL THEN 'no entry matches' ELSE 'targeted more than once' END ELSE '' END AS error
FROM a p LEFT JOIN cat c ON c.row_id = p.row_id""")
def classify_changes(spark, sf):
    found = C.classify_changes(part_catalog(spark, sf), part_changes(spark, sf))
    return found.select(
        "change_id", "action", "row_id",
        F.coalesce(F.array_join(F.transform("changes", lambda x: x["field"]), ","), F.lit("")).alias("fields"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


@query("import_stats", f"SELECT action, count(*) AS n FROM ({ORACLES['classify_changes']}) GROUP BY action")
def import_stats(spark, sf):
    return C.import_stats(C.classify_changes(part_catalog(spark, sf), part_changes(spark, sf)))


@query("normalize_changes", f"""WITH {CAT}, ch AS ({CHANGES.replace('STRING', 'VARCHAR')}),
s AS (SELECT regexp_replace(lower(brand), '[^a-z0-9]', '', 'g') AS fold, trim(brand) AS b, count(*) AS n FROM cat WHERE trim(brand) <> '' GROUP BY 1, 2),
k AS (SELECT fold, arg_min(b, (-n, b)) AS canon FROM s GROUP BY 1),
p AS (SELECT change_id, has_r, CASE WHEN canon IS NOT NULL AND trim(r_brand) <> '' THEN canon ELSE r_brand END AS brand, CAST(r_price AS BIGINT) AS price
  FROM ch LEFT JOIN k ON fold = regexp_replace(lower(r_brand), '[^a-z0-9]', '', 'g')),
r AS (SELECT *, CASE WHEN price > 0 AND floor((price + 2.5) / 5) * 5 > 0 THEN CAST(floor((price + 2.5) / 5) * 5 AS BIGINT) ELSE price END AS rounded FROM p)
SELECT change_id, CASE WHEN has_r THEN brand END AS brand, CASE WHEN has_r THEN CAST(rounded AS VARCHAR) END AS price,
  CASE WHEN has_r THEN CASE WHEN rounded >= 1500 THEN 'Flagship' WHEN rounded >= 500 THEN 'Premium' WHEN rounded >= 100 THEN 'Mid-Tier' ELSE 'Budget' END END AS tier FROM r""")
def normalize_changes(spark, sf):
    out = C.normalize_prices(C.normalize_brands(part_changes(spark, sf), part_catalog(spark, sf)))
    r = F.col("replace")
    return out.select(
        "change_id", r["brand"].alias("brand"), r["price_usd"].alias("price"),
        F.get(F.from_json(r["tags"], "array<string>"), F.lit(0)).alias("tier"),
    )


def order_batch(orders):
    """New prices for a tenth of the orders, a few new orders, and keys to remove."""
    new_price = F.col("o_totalprice") + 1000
    changed = orders.where("o_orderkey % 10 = 3").withColumn("o_totalprice", new_price)
    added = orders.where("o_orderkey % 50 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000)
    return changed.unionByName(added), orders.where("o_orderkey % 10 = 7").select("o_orderkey")


BATCH = """new AS (SELECT * REPLACE (o_totalprice + 1000 AS o_totalprice) FROM orders WHERE o_orderkey % 10 = 3
  UNION ALL SELECT * REPLACE (o_orderkey + 10000000 AS o_orderkey) FROM orders WHERE o_orderkey % 50 = 0),
after AS (SELECT * FROM orders WHERE o_orderkey % 10 NOT IN (3, 7) UNION ALL SELECT * FROM new)"""


@query("upsert", f"WITH {BATCH} SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM after")
def upsert(spark, sf):
    orders = table(spark, sf, "orders")
    rows, removed = order_batch(orders)
    after, _ = C.upsert(orders, rows, removed, key="o_orderkey")
    return after.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("diff_log", """SELECT o_orderkey, 'edit' AS action, 'o_totalprice,' || CASE WHEN o_orderstatus <> 'X' THEN 'o_orderstatus' END AS fields FROM orders WHERE o_orderkey % 10 = 3
UNION ALL SELECT o_orderkey, 'delete', '' FROM orders WHERE o_orderkey % 10 = 7
UNION ALL SELECT o_orderkey + 10000000, 'add', '' FROM orders WHERE o_orderkey % 50 = 0""")
def diff_log(spark, sf):
    orders = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    edited = orders.where(k % 10 != 7).withColumn(
        "o_totalprice", F.when(k % 10 == 3, F.col("o_totalprice") + 1000).otherwise(F.col("o_totalprice"))
    ).withColumn("o_orderstatus", F.when(k % 10 == 3, F.lit("X")).otherwise(F.col("o_orderstatus")))
    added = orders.where(k % 50 == 0).withColumn("o_orderkey", k + 10_000_000)
    log = H.diff_op(orders, edited.unionByName(added), "o_orderkey")
    names = F.array_sort(F.transform("changes", lambda c: c["field"]), lambda a, b: F.when(a > b, -1).otherwise(1))
    return log.select("o_orderkey", "action", F.coalesce(F.array_join(names, ","), F.lit("")).alias("fields"))


@query("old_log", ORACLES["diff_log"])
def old_log(spark, sf):
    """A log of the older form, with both copies of each row, as field differences."""
    orders, k = table(spark, sf, "orders"), F.col("o_orderkey")
    copy = F.struct(*[c for c in orders.columns if c != "o_orderkey"])
    three, was = k % 10 == 3, F.col("copy_before")
    edited = was.withField("o_totalprice", was["o_totalprice"] + 1000).withField("o_orderstatus", F.lit("X"))
    rows = orders.select(F.lit(1).alias("op_id"), k, copy.alias("copy_before"))
    rows = rows.withColumn("copy_after", F.when(three, edited).when(k % 10 != 7, was))
    added = orders.where(k % 50 == 0).select(F.lit(1).alias("op_id"), k + 10_000_000, F.lit(None).alias("copy_before"), copy.alias("copy_after"))
    log = H.from_full_copies(rows.unionByName(added.toDF(*rows.columns)), "o_orderkey")
    names = F.array_sort(F.transform("changes", lambda c: c["field"]), lambda a, b: F.when(a > b, -1).otherwise(1))
    return log.select("o_orderkey", "action", F.coalesce(F.array_join(names, ","), F.lit("")).alias("fields"))


# stretches of mostly new work and stretches of mostly undoing, one history per priority
ACTION = """CASE WHEN o_orderkey % 5000 >= 3500 THEN CASE WHEN o_custkey % 10 < 1 THEN 'do' WHEN o_custkey % 10 < 7 THEN 'undo' ELSE 'redo' END
  WHEN o_custkey % 10 < 6 THEN 'do' WHEN o_custkey % 10 < 8 THEN 'undo' ELSE 'redo' END"""


@query("undo_stacks", f"""WITH RECURSIVE acts AS MATERIALIZED (SELECT o_orderpriority AS history, o_orderkey AS seq, {ACTION} AS action,
    row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n FROM orders),
walk AS (SELECT DISTINCT history, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS u, CAST([] AS BIGINT[]) AS r FROM acts
  UNION ALL SELECT a.history, a.n,
    CASE WHEN action = 'do' THEN list_append(u, seq)[-{KEEP}:] WHEN action = 'undo' THEN u[:-2] WHEN len(r) > 0 THEN list_append(u, r[-1]) ELSE u END,
    CASE WHEN action = 'do' THEN CAST([] AS BIGINT[]) WHEN action = 'redo' THEN r[:-2] WHEN len(u) > 0 THEN list_append(r, u[-1]) ELSE r END
  FROM walk w JOIN acts a ON a.history = w.history AND a.n = w.n + 1),
ends AS (SELECT history, max(n) AS n FROM acts GROUP BY history), last AS (SELECT w.* FROM walk w JOIN ends USING (history, n))
SELECT history, unnest(u) AS seq, 'undo' AS state FROM last UNION ALL SELECT history, unnest(r), 'redo' FROM last""")
def undo_stacks(spark, sf):
    """What can be undone and redone after a long sequence of work, undo and redo."""
    return live_operations(table(spark, sf, "orders").selectExpr("o_orderpriority AS history", "o_orderkey AS seq", f"{ACTION} AS action"))


@query("undo_redo", f"""WITH {BATCH}, second AS (SELECT * REPLACE (CASE WHEN o_orderkey % 10 = 3 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 20 = 3 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice) FROM after WHERE o_orderkey % 30 <> 1)
SELECT 'undo 2' AS step, o_orderkey, o_orderstatus, o_totalprice FROM after
UNION ALL SELECT 'undo 2 1', o_orderkey, o_orderstatus, o_totalprice FROM orders
UNION ALL SELECT 'redo 1 2', o_orderkey, o_orderstatus, o_totalprice FROM second""")
def undo_redo(spark, sf):
    """Two operations on orders, taken back one by one and done again."""
    orders = table(spark, sf, "orders")
    rows, removed = order_batch(orders)
    first, log1 = C.upsert(orders, rows, removed, 1, "o_orderkey")
    # each step below reads these; unsaved, every reading would make them anew with all their joins
    first, log1 = written(first), written(log1)
    k = F.col("o_orderkey")
    second = first.where(k % 30 != 1).withColumn(
        "o_orderstatus", F.when(k % 10 == 3, F.lit("Z")).otherwise(F.col("o_orderstatus"))
    ).withColumn("o_totalprice", F.when(k % 20 == 3, F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice")))
    second = written(second)
    log = log1.unionByName(written(H.diff_op(first, second, "o_orderkey", 2)))
    steps = {
        "undo 2": H.undo(second, log, [2], "o_orderkey"),
        "undo 2 1": H.undo(second, log, [1, 2], "o_orderkey"),
        "redo 1 2": H.redo(orders, log, [1, 2], "o_orderkey"),
    }
    out = None
    for name, df in steps.items():
        part = df.select(F.lit(name).alias("step"), "o_orderkey", "o_orderstatus", "o_totalprice")
        out = part if out is None else out.unionByName(part)
    return out


@query("history_view", """SELECT CAST(o_orderkey % 250 AS BIGINT) AS op_id, count(*) AS n_changes, count(*) FILTER (o_orderstatus = 'F') AS n_added,
  count(*) FILTER (o_orderstatus = 'O') AS n_edited, count(*) FILTER (o_orderstatus = 'P') AS n_deleted,
  CASE WHEN o_orderkey % 250 > 240 THEN 'redo' ELSE 'undo' END AS state FROM orders GROUP BY ALL""")
def history_view(spark, sf):
    orders = table(spark, sf, "orders")
    action = F.when(F.col("o_orderstatus") == "F", "add").when(F.col("o_orderstatus") == "O", "edit").otherwise("delete")
    log = orders.select((F.col("o_orderkey") % 250).alias("op_id"), action.alias("action"))
    return H.history_view(log, log.where("op_id > 240").select("op_id").distinct())


DOC = """CASE WHEN o_orderkey % 6 = 0 THEN '[{"id": "o' || o_orderkey || '", "price_usd": ' || o_custkey || '}, {"id": "p' || o_orderkey || '", "tags": ["a", "b"]}, 7]'
  WHEN o_orderkey % 6 = 1 THEN '```json' || chr(10) || '{"id": "o' || o_orderkey || '", "price_usd": ' || o_custkey || ',}' || chr(10) || '```'
  WHEN o_orderkey % 6 = 2 THEN 'SEARCH:' || chr(10) || '{"id": "o' || o_orderkey || '"}' || chr(10) || 'REPLACE:' || chr(10) || '{"id": "o' || o_orderkey || '", "price_usd": '
    || o_custkey || '}' || chr(10) || 'SEARCH: {"id": "d' || o_orderkey || '"} REPLACE: null'
  WHEN o_orderkey % 6 = 3 THEN 'Here it is: {"id": "o' || o_orderkey || '", "price_usd": ' || o_custkey || ', "model": "a } b"} and that is all'
  WHEN o_orderkey % 6 = 4 THEN 'Two: {"id": "o' || o_orderkey || '", "price_usd": ' || o_custkey || '} then {"id": "x' || o_orderkey || '", "pri'
  ELSE 'nothing to see for ' || o_orderkey END"""


@query("ingest_change_docs", """SELECT o_orderkey AS doc_id, 'entry' AS kind, '' AS search_id, 'o' || o_orderkey AS replace_id, CAST(o_custkey AS VARCHAR) AS price
  FROM orders WHERE o_orderkey % 6 IN (0, 1, 3, 4)
UNION ALL SELECT o_orderkey, 'entry', '', 'p' || o_orderkey, '' FROM orders WHERE o_orderkey % 6 = 0
UNION ALL SELECT o_orderkey, 'pair', 'o' || o_orderkey, 'o' || o_orderkey, CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderkey % 6 = 2
UNION ALL SELECT o_orderkey, 'pair', 'd' || o_orderkey, '', '' FROM orders WHERE o_orderkey % 6 = 2
UNION ALL SELECT o_orderkey, 'error', '', CASE o_orderkey % 6 WHEN 0 THEN 'element 2 is not an object'
  WHEN 4 THEN 'an object never closes; the text looks cut off' ELSE 'no entries found' END, '' FROM orders WHERE o_orderkey % 6 IN (0, 4, 5)""")
def change_docs(spark, sf):
    docs = table(spark, sf, "orders").selectExpr("o_orderkey AS doc_id", f"{DOC} AS text")
    found, errors = ingest_change_docs(docs)

    def field(m, f):
        return F.coalesce(F.col(m)[f], F.lit(""))

    blank = F.lit("")
    return found.select(
        "doc_id", "kind", field("search", "id").alias("search_id"), field("replace", "id").alias("replace_id"), field("replace", "price_usd").alias("price")
    ).unionByName(
        errors.select("doc_id", F.lit("error").alias("kind"), blank.alias("search_id"), F.col("error").alias("replace_id"), blank.alias("price"))
    )


@query("link_files", f"""WITH {CAT}, w AS (SELECT id, row_id, CASE WHEN row_id % 2 = 0 THEN 'media/' ELSE 'archive/' END || model || '.txt' AS path FROM cat WHERE id <> ''),
t AS (SELECT id, min(row_id) AS row_id FROM cat WHERE id <> '' GROUP BY 1),
o AS (SELECT t.row_id, path, min(-w.row_id) AS seq FROM w JOIN t USING (id) GROUP BY 1, 2),
f AS (SELECT row_id, list(path ORDER BY seq) AS more FROM o GROUP BY 1)
SELECT cat.row_id, array_to_string(list_concat(files, coalesce(more, [])), ',') AS files FROM cat LEFT JOIN f ON f.row_id = cat.row_id""")
def link_files_query(spark, sf):
    catalog = part_catalog(spark, sf)
    folder = F.when(F.col("row_id") % 2 == 0, "media//").otherwise("archive/")
    wanted = catalog.where("id <> ''").select("id", F.concat(folder, "model", F.lit(".txt")).alias("path"), (-F.col("row_id")).alias("seq"))
    after, _ = link_files(catalog, wanted)
    return after.select("row_id", show_list("files").alias("files"))


# valid entries; some pairs of them would get one id by the edit
MODEL = """CASE WHEN p_partkey % 100 = 10 THEN 'ring ' || CAST(p_partkey AS STRING) WHEN p_partkey % 100 = 11 THEN 'hoop ' || CAST(p_partkey - 1 AS STRING)
  WHEN p_partkey % 3 = 0 THEN 'ring ' || p_name || ' ' || CAST(p_partkey AS STRING) ELSE p_name || ' ' || CAST(p_partkey AS STRING) END"""
BRAND = "CASE WHEN p_partkey % 100 IN (10, 11) THEN 'Same' ELSE p_brand END"
PRICE = "CAST(floor(p_retailprice / 5) * 5 AS INT)"
TIER = f"CASE WHEN {PRICE} >= 1500 THEN 'Flagship' WHEN {PRICE} >= 500 THEN 'Premium' WHEN {PRICE} >= 100 THEN 'Mid-Tier' ELSE 'Budget' END"
FOLDED = "lower(replace({0}, '#', '_')) || '_' || replace({1}, ' ', '_')"
GOOD = {
    "row_id": "p_partkey", "id": FOLDED.format(BRAND, MODEL), "brand": BRAND, "model": MODEL, "variant": "''",
    "year": "2000 + p_size % 20", "price_usd": PRICE, "driver_type": "'DD'", "driver_config": "'1DD'", "impedance": "p_size",
    "sensitivity": "100", "connector": "'2-pin'", "form_factor": "'IEM'", "tags": f"LIST({TIER}, 'Warm', 'Smooth', 'Relaxed')",
    "files": "LIST('data/' || CAST(p_partkey AS STRING) || '.txt')",
}


def good_catalog(spark, sf):
    return table(spark, sf, "part").selectExpr(*columns(GOOD, spark_sql))


@query("apply_edits", f"""WITH g AS (SELECT p_partkey AS row_id, {BRAND} AS brand, {MODEL} AS model FROM part),
e AS (SELECT *, replace(model, 'ring', 'hoop') AS new FROM g),
i AS (SELECT *, {FOLDED.format('brand', 'model')} AS id, {FOLDED.format('brand', 'new')} AS new_id FROM e),
j AS (SELECT *, new <> model AND new_id IN (SELECT id FROM i) AS refused FROM i)
SELECT row_id, CASE WHEN refused THEN id ELSE new_id END AS id, CASE WHEN refused THEN model ELSE new END AS model,
  CASE WHEN refused THEN 'id is used by another entry: ' || new_id ELSE '' END AS reason, new <> model AND NOT refused AS logged FROM j""")
def apply_edits(spark, sf):
    """Find and replace on models of valid entries: ids follow, and an id another entry has is refused."""
    catalog = good_catalog(spark, sf)
    found = E.find_replace(catalog, "model", "ring", "hoop")
    after, log, problems = E.apply_edits(catalog, "model", found, last_year=LAST_YEAR)
    logged = log.where("action = 'edit'").select("row_id", F.lit(True).alias("logged"))
    return after.join(problems, "row_id", "left").join(logged, "row_id", "left").select(
        "row_id", "id", "model", F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("logged", F.lit(False)).alias("logged")
    )


@query("merge_pair_outcome", f"""WITH g AS (SELECT p_partkey AS k, {FOLDED.format(BRAND, MODEL)} AS id, {TIER} AS tier, 'data/' || CAST(p_partkey AS VARCHAR) || '.txt' AS file FROM part),
p AS (SELECT a.k AS a, b.k AS b, a.k % 4 = 1 AND (a.k - 1) IN (SELECT k FROM g) AS late FROM g a JOIN g b ON b.k = a.k + 1 WHERE a.k % 4 IN (0, 1)),
m AS (SELECT g.*, x.b AS other FROM g LEFT JOIN p x ON x.a = g.k AND NOT x.late)
SELECT 'row' AS kind, k AS row_id, id, CASE WHEN other IS NULL THEN tier || ',Warm,Smooth,Relaxed' ELSE 'Warm,Smooth,Relaxed,' || tier END AS tags,
  CASE WHEN other IS NULL THEN file ELSE file || ',data/' || CAST(other AS VARCHAR) || '.txt' END AS files
FROM m WHERE k NOT IN (SELECT b FROM p WHERE NOT late)
UNION ALL SELECT 'rejected', a, CAST(b AS VARCHAR), 'a row of this pair is in an earlier merge', '' FROM p WHERE late""")
def merge_pair_outcome(spark, sf):
    """Neighbours merged in one pass: the rows after it, and the pairs that have to wait for the next."""
    catalog = good_catalog(spark, sf)
    a = catalog.where("row_id % 4 IN (0, 1)").select(F.col("row_id").alias("key_a"), (F.col("row_id") + 1).alias("key_b"))
    pairs = a.join(catalog.select(F.col("row_id").alias("key_b")), "key_b", "left_semi").select("key_a", "key_b")
    after, _, rejected = merge_pair(catalog, pairs, last_year=LAST_YEAR)
    rows = after.select(F.lit("row").alias("kind"), "row_id", "id", show_list("tags").alias("tags"), show_list("files").alias("files"))
    return rows.unionByName(
        rejected.select(
            F.lit("rejected").alias("kind"), F.col("key_a").alias("row_id"), F.col("key_b").cast("string").alias("id"),
            F.col("reason").alias("tags"), F.lit("").alias("files"),
        )
    )


# what is proposed for each valid entry: a price, a deletion, a new product, no change, another name (free or taken)
TIER5 = TIER.replace(PRICE, f"({PRICE} + 5)")
TAGGED = "{0} || ',Warm,Smooth,Relaxed'"


@query("import_batch", f"""WITH g AS (SELECT p_partkey AS k, {BRAND} AS brand, {MODEL} AS model, {PRICE} AS price, {TIER} AS tier, {TIER5} AS tier5 FROM part),
i AS (SELECT *, {FOLDED.format('brand', 'model')} AS id FROM g),
t AS (SELECT a.*, b.id AS taken FROM i a LEFT JOIN i b ON b.k = a.k + 2 AND a.k % 12 = 10 AND b.brand = a.brand),
top AS (SELECT max(k) AS last FROM g)
SELECT 'row' AS kind, k AS row_id, CASE WHEN k % 12 = 4 THEN id || '_x' ELSE id END AS id, CASE WHEN k % 6 = 0 THEN price + 5 ELSE price END AS price_usd,
  {TAGGED.format("CASE WHEN k % 6 = 0 THEN tier5 ELSE tier END")} AS tags FROM i WHERE k % 6 <> 1
UNION ALL SELECT 'row', last + 1 + k, id || '_zz', price, {TAGGED.format('tier')} FROM i, top WHERE k % 6 = 2
UNION ALL SELECT 'problem', k, 'id is used by another entry: ' || taken, 0, '' FROM t WHERE taken IS NOT NULL""")
def import_batch(spark, sf):
    """The whole batch over valid entries: normalize, classify, select, stage, apply; rows and problems."""
    catalog = good_catalog(spark, sf)
    k = F.col("row_id")
    later = catalog.select((k - 2).alias("row_id"), F.col("brand").alias("_b"), F.col("model").alias("_m"))
    known = catalog.join(later, "row_id", "left")
    taken = (k % 12 == 10) & (F.col("_b") == F.col("brand"))
    known = known.withColumn("deletes", k % 6 == 1).withColumn("kind", F.when((k % 6).isin(2, 3), "entry").otherwise("pair")).withColumns(
        {
            "was": F.col("id"),
            "model": F.when(k % 6 == 2, F.concat("model", F.lit(" zz"))).when(k % 12 == 4, F.concat("model", F.lit(" x")))
            .when(taken, F.col("_m")).otherwise(F.col("model")),
            "id": F.when(k % 6 == 2, "").otherwise(F.col("id")),
            "price_usd": F.when(k % 6 == 0, F.col("price_usd") + 5).otherwise(F.col("price_usd")),
        }
    )
    entry = F.create_map(
        *[x for f in S.FIELDS for x in (F.lit(f), F.to_json(f) if f in S.LIST_FIELDS else F.col(f).cast("string"))]
    )
    search = F.create_map(F.lit("id"), F.col("was"))
    changes = known.select(
        F.col("row_id").alias("change_id"), "kind", F.when(F.col("kind") == "pair", search).alias("search"),
        F.when(~F.col("deletes"), entry).alias("replace"),
    )
    ready = C.normalize_prices(C.normalize_brands(changes, catalog))
    proposals = C.classify_changes(catalog, ready)
    chosen = proposals.select("change_id", F.lit(None).cast("array<string>").alias("fields"))
    staged, problems, _ = C.stage(C.merge_fields(proposals, chosen), catalog)
    after, _ = C.apply_changes(catalog, staged)
    return after.select(F.lit("row").alias("kind"), "row_id", "id", "price_usd", show_list("tags").alias("tags")).unionByName(
        problems.select(
            F.lit("problem").alias("kind"), F.col("change_id").alias("row_id"), F.col("error").alias("id"),
            F.lit(0).alias("price_usd"), F.lit("").alias("tags"),
        )
    )
