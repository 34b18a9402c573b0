"""Links, spellings, duplicate ids and duplicate names over the driver tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import duplicates as D
from ..operators import links as K
from ..operators import lookup as L
from ..operators import spelling as SP
from ..operators.merge import first_pairs, merged_entries
from .base import query, show_list, table
from .catalog_queries import CAT, DISK, disk_files, part_catalog


@query("duplicate_ids", """WITH n AS (SELECT l_orderkey, l_linenumber, l_extendedprice,
  l_partkey * 1000003 + l_suppkey * 101 + CAST(l_extendedprice * 100 AS BIGINT) AS row_no FROM lineitem),
f AS (SELECT l_orderkey, l_linenumber, min(row_no) AS first_row FROM n GROUP BY 1, 2 HAVING count(*) > 1)
SELECT l_orderkey, l_linenumber, row_no, first_row FROM n JOIN f USING (l_orderkey, l_linenumber) WHERE row_no > first_row""")
def duplicate_ids(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        (F.col("l_partkey") * 1000003 + F.col("l_suppkey") * 101 + F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("row_no"),
    )
    return K.duplicate_ids(rows, ["l_orderkey", "l_linenumber"], "row_no")


WORDS = r"""w AS (SELECT regexp_replace(unnest(string_split(replace(text, chr(10), ' '), ' ')), '[.,]+$', '') AS word FROM documents),
c AS (SELECT regexp_replace(lower(regexp_replace(strip_accents(trim(word)), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]', '', 'g') AS fold,
  trim(word) AS spelling, count(*) AS n FROM w GROUP BY 1, 2),
g AS (SELECT * FROM c WHERE fold <> '' AND spelling <> '')"""


def words(spark, sf):
    text = F.replace("text", F.lit("\n"), F.lit(" "))
    return table(spark, sf, "documents").select(F.explode(F.split(text, " ")).alias("word"))


def without_stops(c):
    return F.regexp_replace(c, "[.,]+$", "")


@query("canonical_spelling", f"""WITH {WORDS}
SELECT fold, arg_min(spelling, (-n, spelling)) AS canonical, max(n) AS n, count(*) AS n_spellings FROM g GROUP BY fold""")
def canonical_spelling(spark, sf):
    return SP.canonical_spelling(words(spark, sf), "word", clean=without_stops)


@query("spelling_fixes", f"""WITH {WORDS},
s AS (SELECT fold, arg_min(spelling, (-n, spelling)) AS canonical, max(n) AS top, count(*) AS k,
  string_agg('''' || spelling || ''' (' || n || ')', ', ' ORDER BY n DESC, spelling) AS summary FROM g GROUP BY fold HAVING count(*) > 1),
t AS (SELECT s.fold, count(*) AS at_top FROM s JOIN g ON g.fold = s.fold AND g.n = s.top GROUP BY 1)
SELECT s.fold, g.spelling, canonical, summary, at_top = 1 AS has_majority FROM s JOIN t USING (fold) JOIN g USING (fold)
WHERE g.spelling <> canonical""")
def spelling_fixes(spark, sf):
    return SP.spelling_fixes(words(spark, sf), "word", clean=without_stops)


@query("missing_links", """SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey * 3 NOT IN (SELECT p_partkey FROM part)
GROUP BY ALL""")
def missing_links(spark, sf):
    """Order lines whose linked path (three times the part key) is not in the inventory."""
    catalog = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("row_id"), F.array((F.col("l_partkey") * 3).cast("string")).alias("files")
    )
    files = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("path"))
    return K.missing_files(catalog, files).select(
        F.col("row_id").alias("l_orderkey"), (F.col("path").cast("bigint") / 3).cast("bigint").alias("l_partkey")
    )


@query("unlinked_items", """SELECT CAST(p_partkey AS VARCHAR) AS path FROM part
WHERE p_partkey NOT IN (SELECT CASE WHEN l_quantity > 48 THEN l_partkey ELSE -l_partkey END FROM lineitem)""")
def unlinked_items(spark, sf):
    """Parts that no large order line names; the small lines name paths that do not exist."""
    path = F.when(F.col("l_quantity") > 48, F.col("l_partkey")).otherwise(-F.col("l_partkey")).cast("string")
    catalog = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.array(path).alias("files"))
    files = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("path"))
    return K.unlinked_files(catalog, files)


@query("fold_duplicates", r"""WITH w AS (SELECT doc_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS raw FROM documents),
p AS (SELECT doc_id, trim(regexp_replace(trim(replace(raw, chr(92), '/')), '/+', '/', 'g')) AS path FROM w),
q AS (SELECT doc_id, replace(regexp_replace(path, '^(\./)+', ''), '/./', '/') AS path FROM p)
SELECT lower(path) AS fold, count(*) AS n_links, count(DISTINCT path) AS n_spellings, min(doc_id) AS first_key, max(doc_id) AS last_key
FROM q WHERE path <> '' GROUP BY 1 HAVING count(*) > 1""")
def fold_duplicates(spark, sf):
    """D4 by case fold, with the words of each document as its links."""
    docs = table(spark, sf, "documents").select(
        "doc_id", F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ").alias("files")
    )
    return K.link_counts(docs, "doc_id", fold=True)


URLS = "list_value(CASE WHEN page_id % 3 = 0 THEN upper(url) ELSE url END, url || '#gone', url, replace(url, '/', chr(92)))"


def url_links(spark, sf):
    return table(spark, sf, "pages").selectExpr(
        "page_id AS row_id",
        "array(CASE WHEN page_id % 3 = 0 THEN upper(url) ELSE url END, url || '#gone', url, replace(url, '/', chr(92))) AS files",
    )


@query("path_case_repair", f"""WITH l AS (SELECT page_id, unnest({URLS}) AS old, generate_subscripts({URLS}, 1) - 1 AS pos FROM pages),
d AS (SELECT lower(url) AS fold, max(url) AS disk FROM pages GROUP BY 1)
SELECT page_id AS row_id, pos, old, disk AS new FROM l JOIN d ON lower(old) = fold WHERE old <> disk""")
def path_case_repair(spark, sf):
    files = table(spark, sf, "pages").select(F.col("url").alias("path"))
    return K.repair_path_case(url_links(spark, sf), files)


@query("strip_phantoms", f"""WITH l AS (SELECT page_id, unnest({URLS}) AS raw, generate_subscripts({URLS}, 1) AS pos FROM pages),
n AS (SELECT *, regexp_replace(trim(replace(raw, chr(92), '/')), '/+', '/', 'g') AS path FROM l),
disk AS (SELECT DISTINCT regexp_replace(url, '/+', '/', 'g') AS p FROM pages),
d AS (SELECT lower(p) AS fold, max(p) AS disk FROM disk GROUP BY 1),
u AS (SELECT n.*, CASE WHEN x.p IS NOT NULL THEN n.path ELSE d.disk END AS use FROM n LEFT JOIN disk x ON x.p = n.path LEFT JOIN d ON d.fold = lower(n.path)),
k AS (SELECT page_id, lower(use) AS f, arg_min(use, pos) AS use, min(pos) AS pos FROM u WHERE use IS NOT NULL GROUP BY 1, 2),
kk AS (SELECT page_id, string_agg(use, ',' ORDER BY pos) AS kept FROM k GROUP BY 1),
dd AS (SELECT page_id, string_agg(raw, ',' ORDER BY pos) AS dropped FROM u WHERE use IS NULL GROUP BY 1)
SELECT p.page_id AS row_id, coalesce(kept, '') AS kept, coalesce(dropped, '') AS dropped FROM pages p LEFT JOIN kk USING (page_id) LEFT JOIN dd USING (page_id)""")
def strip_phantoms(spark, sf):
    files = table(spark, sf, "pages").select(F.regexp_replace("url", "/+", "/").alias("path")).distinct()
    out = K.strip_phantom_files(url_links(spark, sf), files)
    return out.select("row_id", show_list("kept").alias("kept"), show_list("dropped").alias("dropped"))


@query("shared_link_pairs", """WITH l AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS k FROM lineitem),
s AS (SELECT o, count(*) AS n, min(k) AS f FROM l GROUP BY 1 HAVING count(*) > 1)
SELECT 'group' AS kind, o AS path, n AS a, n * (n - 1) // 2 AS b, f AS first_key FROM s
UNION ALL SELECT 'member', l.o, k, NULL, f FROM l JOIN s ON s.o = l.o""")
def shared_link_pairs(spark, sf):
    """Parts ordered together: every order once with its exact counts, and its parts next to the first one."""
    linked = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("row_id"), F.col("l_orderkey").alias("path"))
    groups, members = K.shared_files(linked)
    return groups.select(F.lit("group").alias("kind"), "path", F.col("n").alias("a"), F.col("n_pairs").alias("b"), "first_key").unionByName(
        members.select(F.lit("member").alias("kind"), "path", F.col("key").alias("a"), F.lit(None).cast("bigint").alias("b"), "first_key")
    )


# names with digits, generations and slips, so every rule has work to do
NAME = """p_name || CASE WHEN p_size % 9 = 0 THEN ' mk' || CAST(p_size % 4 AS STRING) WHEN p_size % 9 = 1 THEN ' ii'
  WHEN p_size % 9 = 2 THEN ' pro' WHEN p_size % 9 = 3 THEN 's' WHEN p_size % 9 = 4 THEN ' 10' || CAST(p_size % 5 AS STRING) ELSE '' END"""
SPECS = ["p_type", "p_size", "price"]


def named_parts(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS row_id", "lower(p_brand) AS block", f"{NAME} AS name", "p_type", "p_size",
        "CAST(floor(p_retailprice) AS INT) AS price",
    )


ROMAN = """list_transform(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t:
  CASE t WHEN 'ii' THEN '2' WHEN 'iii' THEN '3' WHEN 'iv' THEN '4' WHEN 'vi' THEN '6' ELSE t END)"""
NAME_PAIRS = f"""r AS (SELECT p_partkey AS id, lower(p_brand) AS block, array_to_string({ROMAN.format(NAME)}, ' ') AS name,
  p_type || '|' || p_size || '|' || CAST(floor(p_retailprice) AS INT) AS sig FROM part),
n AS (SELECT block, name, count(*) AS n, min(id) AS r0, string_split(name, ' ') AS t FROM r GROUP BY 1, 2),
s AS (SELECT block, name, sig, count(*) AS n FROM r GROUP BY 1, 2, 3),
x AS (SELECT a.block, a.name AS a, b.name AS b, a.n AS na, b.n AS nb, a.t AS ta, b.t AS tb, length(a.name) AS la, length(b.name) AS lb,
    1.0 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name))::DOUBLE AS ratio,
    CASE WHEN starts_with(b.name, a.name || ' ') THEN trim(substr(b.name, length(a.name) + 1))
         WHEN starts_with(a.name, b.name || ' ') THEN trim(substr(a.name, length(b.name) + 1)) END AS rest,
    len(list_filter(range(1, least(length(a.name), length(b.name)) + 1), lambda i: left(a.name, i) = left(b.name, i))) AS p,
    list_filter(list_distinct(a.t), lambda w: NOT list_contains(b.t, w)) AS da, list_filter(list_distinct(b.t), lambda w: NOT list_contains(a.t, w)) AS db
  FROM n a JOIN n b ON a.block = b.block AND a.name <> b.name AND (a.r0 < b.r0 OR (a.r0 = b.r0 AND a.name < b.name))),
y AS (SELECT *, string_split(rest, ' ') AS rw FROM x),
z AS (SELECT *, CASE WHEN ratio >= 0.84 THEN 'similar' WHEN rest IS NOT NULL THEN 'extends' END AS kind FROM y
  WHERE NOT coalesce(rest IS NOT NULL AND (
      len(list_filter(rw, lambda w: w NOT IN ('2','3','4','5','6','7','8','ii','iii','iv','vi','mk2','mk3','mk4','dsp'))) = 0
      OR len(list_filter(rw, lambda w: NOT regexp_full_match(w, '[0-9]+'))) = 0), false)
    AND NOT coalesce(len(da) = 1 AND len(db) = 1 AND regexp_full_match(da[1], '[a-z]*[0-9]{{1,5}}[a-z]*') AND regexp_full_match(db[1], '[a-z]*[0-9]{{1,5}}[a-z]*')
      AND regexp_extract(da[1], '^([a-z]*)([0-9]+)', 1) = regexp_extract(db[1], '^([a-z]*)([0-9]+)', 1)
      AND regexp_extract(da[1], '([a-z]*)$', 1) = regexp_extract(db[1], '([a-z]*)$', 1)
      AND regexp_extract(da[1], '([0-9]+)', 1) <> regexp_extract(db[1], '([0-9]+)', 1), false)
    AND (rest IS NOT NULL OR 2.0 * least(la, lb) / (la + lb) >= 0.84)
    AND NOT CASE WHEN p >= 3 THEN regexp_full_match(substr(a, p + 1), '[0-9]*') AND regexp_full_match(substr(b, p + 1), '[0-9]*')
      ELSE len(list_intersect(ta, tb)) = 0 AND (abs(la - lb) > 2 OR p < 2) END),
h AS (SELECT z.block, z.a, z.b, sum(sa.n * sb.n) AS n_high FROM z JOIN s sa ON sa.block = z.block AND sa.name = z.a
  JOIN s sb ON sb.block = z.block AND sb.name = z.b AND sb.sig = sa.sig WHERE kind = 'similar' GROUP BY 1, 2, 3),
pairs AS (SELECT z.block, z.a AS name_a, z.b AS name_b, ratio, kind, na * nb AS n_pairs, CAST(coalesce(n_high, 0) AS BIGINT) AS n_high
  FROM z LEFT JOIN h ON h.block = z.block AND h.a = z.a AND h.b = z.b WHERE kind IS NOT NULL
UNION ALL SELECT block, name, name, 1.0, 'similar', n * (n - 1) // 2, CAST((SELECT sum(s.n * (s.n - 1) // 2) FROM s WHERE s.block = n.block AND s.name = n.name) AS BIGINT)
  FROM n WHERE n > 1)"""


@query("name_pairs", f"""WITH {NAME_PAIRS}
SELECT block, name_a, name_b, ratio, kind, n_pairs, n_high, CASE WHEN kind = 'similar' THEN n_pairs - n_high ELSE 0 END AS n_medium,
  CASE WHEN kind = 'extends' THEN n_pairs ELSE 0 END AS n_low FROM pairs""")
def name_pairs(spark, sf):
    parts = named_parts(spark, sf)
    return D.brand_fuzzy_pairs(parts, "block", D.dup_name("name", F.lit("")), SPECS, method="levenshtein")


@query("name_pairs_gestalt")
def name_pairs_gestalt(spark, sf):
    parts = named_parts(spark, sf)
    return D.brand_fuzzy_pairs(parts, "block", D.dup_name("name", F.lit("")), SPECS, method="gestalt")


@query("name_pair_rows", f"""WITH {NAME_PAIRS}, named AS (SELECT block, name_a AS name FROM pairs UNION SELECT block, name_b FROM pairs)
SELECT 'pair' AS kind, p.block, p.name_a AS name, p.name_b AS other, a.r0 AS key_a, CASE WHEN p.name_a <> p.name_b THEN b.r0 END AS key_b, n_pairs
FROM pairs p JOIN n a ON a.block = p.block AND a.name = p.name_a JOIN n b ON b.block = p.block AND b.name = p.name_b
UNION ALL SELECT 'row', r.block, r.name, NULL, r.id, n.r0, NULL FROM r JOIN named d ON d.block = r.block AND d.name = r.name
  JOIN n ON n.block = r.block AND n.name = r.name""")
def name_pair_rows(spark, sf):
    """Alike names with their first rows and counts, and every row that bears one of them."""
    parts, name = named_parts(spark, sf), D.dup_name("name", F.lit(""))
    found = D.brand_fuzzy_pairs(parts, "block", name, SPECS, method="levenshtein")
    pairs, bearers = D.name_groups(found, parts, F.col("block"), name)
    return pairs.select(
        F.lit("pair").alias("kind"), "block", F.col("name_a").alias("name"), F.col("name_b").alias("other"), "key_a", "key_b", "n_pairs"
    ).unionByName(
        bearers.select(
            F.lit("row").alias("kind"), "block", "name", F.lit(None).cast("string").alias("other"), F.col("key").alias("key_a"),
            F.col("first_key").alias("key_b"), F.lit(None).cast("bigint").alias("n_pairs"),
        )
    )


# neighbours of one brand and name are merged; each row in its first pair only
PAIRS = f"""{CAT},
nb AS (SELECT brand, model, row_id, lead(row_id) OVER (PARTITION BY brand, model ORDER BY row_id) AS nxt FROM cat WHERE brand <> ''),
pairs AS (SELECT row_id AS key_a, nxt AS key_b FROM nb WHERE nxt IS NOT NULL),
ends AS (SELECT r, min(a) AS fa FROM (SELECT key_a AS r, key_a AS a FROM pairs UNION ALL SELECT key_b, key_a FROM pairs) GROUP BY 1),
now AS (SELECT p.* FROM pairs p JOIN ends x ON x.r = p.key_a JOIN ends y ON y.r = p.key_b WHERE x.fa = p.key_a AND y.fa = p.key_a)"""
PICK = ", ".join(
    f"CASE WHEN a.{f} = 0 AND b.{f} <> 0 THEN b.{f} ELSE a.{f} END AS {f}" for f in ("year", "price_usd", "impedance", "sensitivity")
) + ", " + ", ".join(
    f"CASE WHEN trim(a.{f}) = '' AND trim(b.{f}) <> '' THEN b.{f} ELSE a.{f} END AS {f}"
    for f in ("brand", "model", "variant", "driver_type", "driver_config", "connector", "form_factor")
)


def neighbour_pairs(catalog):
    w = Window.partitionBy("brand", "model").orderBy("row_id")
    return catalog.where("brand <> ''").select(F.col("row_id").alias("key_a"), F.lead("row_id").over(w).alias("key_b")).where("key_b IS NOT NULL")


@query("merge_pairs", f"""WITH {PAIRS},
m AS (SELECT key_a, key_b, {PICK},
  CASE WHEN len(a.tags) < len(b.tags) THEN b.tags ELSE a.tags END AS tags,
  list_concat(list_filter(a.files, lambda f, i: list_position(a.files, f) = i),
    list_filter(b.files, lambda f, i: list_position(b.files, f) = i AND NOT list_contains(a.files, f))) AS files
  FROM now JOIN cat a ON a.row_id = key_a JOIN cat b ON b.row_id = key_b),
t AS (SELECT *, CASE WHEN price_usd < 0 OR price_usd % 5 = 0 THEN CAST(price_usd AS DOUBLE) ELSE floor((price_usd + 2.5) / 5) * 5 END AS basis FROM m)
SELECT key_a, key_b, year, price_usd, impedance, sensitivity, brand, model, variant, driver_type, driver_config, connector, form_factor,
  array_to_string(list_append(list_filter(tags, lambda x: x NOT IN ('Budget', 'Mid-Tier', 'Premium', 'Flagship')),
    CASE WHEN basis >= 1500 THEN 'Flagship' WHEN basis >= 500 THEN 'Premium' WHEN basis >= 100 THEN 'Mid-Tier' ELSE 'Budget' END), ',') AS tags,
  array_to_string(files, ',') AS files,
  array_to_string(list_filter([regexp_replace(lower(brand), '[^a-z0-9]+', '_', 'g'), replace(model, ' ', '_'), variant], lambda c: c <> ''), '_') AS id
FROM t""")
def merge_pairs(spark, sf):
    """C9 before its validation: the merged entry of every pair."""
    catalog = part_catalog(spark, sf)
    now, _ = first_pairs(neighbour_pairs(catalog))
    out = merged_entries(catalog, now)
    return out.withColumn("tags", show_list("tags")).withColumn("files", show_list("files"))


@query("available_files", f"""WITH {CAT}, disk AS ({DISK}),
l AS (SELECT regexp_replace(trim(replace(unnest(files), chr(92), '/')), '/+', '/', 'g') AS path FROM cat)
SELECT path FROM disk WHERE path NOT IN (SELECT path FROM l) AND contains(lower(path), 'brand#1')""")
def available_files(spark, sf):
    return K.available_files(disk_files(spark, sf), part_catalog(spark, sf), "brand#1")


@query("unique_names", """WITH n AS (SELECT p_partkey, p_name || '.TXT' AS name, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS k FROM part)
SELECT p_partkey, CASE WHEN k = 1 THEN replace(name, '.TXT', '.txt') ELSE replace(name, '.TXT', ' (' || k || ').txt') END AS unique_name FROM n""")
def unique_names(spark, sf):
    names = table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit(".TXT")).alias("name"))
    return L.unique_names(names, "name", "p_partkey").select("p_partkey", "unique_name")
