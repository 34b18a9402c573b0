"""Catalog rules over ``part``: every part is an entry, with defects derived from its columns."""

import uuid

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import audit as A
from ..operators import issues as I
from ..operators import lookup as L
from ..operators import validate as V
from ..operators.edits import find_replace, rename_tag
from ..operators.fixes import apply_fixes
from ..session import shared_folder, written
from ..sources.catalog import clean_catalog, read_catalog, write_catalog
from .base import columns, duck_sql, fix_text, query, show_list, spark_sql, table

LAST_YEAR = 2027

PART = {
    "row_id": "p_partkey",
    "id": """CASE WHEN p_partkey % 7 = 2 THEN upper(p_name)
        WHEN p_partkey % 61 = 5 THEN ''
        ELSE 'brand_' || substr(p_brand, 7) || '_' || replace(p_name, ' ', '_')
             || CASE WHEN p_partkey % 3 = 0 THEN '_' || lower(p_type) ELSE '' END END""",
    "brand": """CASE WHEN p_partkey % 11 = 3 THEN upper(p_brand) WHEN p_partkey % 97 = 0 THEN ''
        ELSE p_brand END""",
    "model": "p_name",
    "variant": "CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) ELSE '' END",
    "year": "CAST(CASE WHEN p_partkey % 13 = 5 THEN 0 ELSE 1940 + p_size * 2 END AS INT)",
    "price_usd": """CAST(CASE WHEN p_partkey % 29 = 4 THEN 0 WHEN p_partkey % 31 = 7 THEN -5
        ELSE CAST(floor(p_retailprice * 7) AS INT) % 2000 END AS INT)""",
    "driver_type": """CASE WHEN p_partkey % 5 = 0 THEN 'DD' WHEN p_partkey % 5 = 1 THEN 'Hybrid'
        WHEN p_partkey % 5 = 2 THEN '' WHEN p_partkey % 5 = 3 THEN 'EST' ELSE 'Tribrid' END""",
    "driver_config": """CASE WHEN p_size % 8 = 0 THEN '' WHEN p_size % 8 = 1 THEN '1DD'
        WHEN p_size % 8 = 2 THEN '2BA + 1DD' WHEN p_size % 8 = 3 THEN '1dd+2ba'
        WHEN p_size % 8 = 4 THEN '1BA+1DD' WHEN p_size % 8 = 5 THEN '3XX+1DD'
        WHEN p_size % 8 = 6 THEN '4Planar+1EST+2BA' ELSE 'foo' END""",
    "impedance": """CAST(CASE WHEN p_partkey % 17 = 1 THEN -p_size WHEN p_partkey % 19 = 2 THEN 250000 + p_size
        WHEN p_partkey % 23 = 3 THEN 0 ELSE p_size END AS INT)""",
    "sensitivity": """CAST(CASE WHEN p_partkey % 37 = 1 THEN 300 WHEN p_partkey % 41 = 2 THEN 0
        ELSE 90 + p_size % 30 END AS INT)""",
    "connector": """CASE WHEN p_partkey % 9 = 0 THEN 'Bluetooth' WHEN p_partkey % 9 < 4 THEN '2-pin'
        WHEN p_partkey % 9 = 4 THEN 'Electrostatic' WHEN p_partkey % 9 = 5 THEN 'USB'
        WHEN p_partkey % 9 = 6 THEN '' WHEN p_partkey % 9 = 7 THEN 'MMCX' ELSE 'Detachable Cable' END""",
    "form_factor": """CASE WHEN p_size % 7 < 3 THEN 'IEM' WHEN p_size % 7 = 3 THEN 'Wireless Earbuds (TWS)'
        WHEN p_size % 7 = 4 THEN 'Over-Ear Headphones (Wired)' WHEN p_size % 7 = 5 THEN 'Boombox' ELSE '' END""",
    "tags": """CASE WHEN p_partkey % 6 = 0 THEN LIST('Budget', 'Warm', 'Fun', 'Gaming')
        WHEN p_partkey % 6 = 1 THEN LIST('Warm', 'Bright', 'Mid-Tier', 'Neutral', 'V-Shaped')
        WHEN p_partkey % 6 = 2 THEN LIST('Premium', 'Fun', 'Fun', 'Loud', 'Flagship')
        WHEN p_partkey % 6 = 3 THEN LIST('Smooth')
        WHEN p_partkey % 6 = 4 THEN LIST('Balanced', 'Neutral', 'U-Shaped', 'Premium')
        ELSE LIST('Smooth', 'Relaxed', 'Detailed', 'Premium', 'Wide-Stage') END""",
    "files": """CASE WHEN p_partkey % 10 = 0 THEN LIST('data/' || p_brand || '/' || p_name || '.txt', '')
        WHEN p_partkey % 10 = 1 THEN LIST(' data/' || p_brand || '/' || p_name || '.txt')
        WHEN p_partkey % 10 = 2 THEN LIST('data' || chr(92) || p_brand || '/' || p_name || '.txt')
        WHEN p_partkey % 10 = 3 THEN LIST('../x/' || p_name || '.txt', 'a.txt', 'a.txt')
        WHEN p_partkey % 10 = 4 THEN LIST('DATA/' || p_brand || '/' || p_name || '.txt')
        ELSE LIST('data/' || p_brand || '/' || CAST(p_partkey AS STRING) || '.txt') END""",
}

# the files that exist: one per brand and name, and one for most parts
DISK = """SELECT 'data/' || p_brand || '/' || p_name || '.txt' AS path FROM part
UNION SELECT CASE WHEN p_size > 4 THEN 'data/' ELSE 'spare/' END || p_brand || '/' || CAST(p_partkey AS STRING) || '.txt' FROM part"""

CAT = f"""cat AS (SELECT {', '.join(columns(PART, duck_sql))} FROM part)"""
TIERS = "('Budget', 'Mid-Tier', 'Premium', 'Flagship')"

# what the rules derive from a row
FACTS = CAT + r""",
base AS (
  SELECT *,
    list_transform(list_filter(string_split(replace(trim(driver_config), ' ', ''), '+'), lambda t: t <> ''), lambda t: {
      'raw': t,
      'n': TRY_CAST(regexp_extract(t, '^(\d+)([A-Za-z]+)$', 1) AS BIGINT),
      'tech': list_filter(['DD', 'BA', 'Planar', 'EST', 'MEMS', 'PZT', 'BC'],
                lambda k: upper(k) = upper(regexp_extract(t, '^(\d+)([A-Za-z]+)$', 2)))[1]}) AS toks,
    array_to_string(list_filter([
        trim(regexp_replace(replace(lower(brand), '+', '_plus_'), '[^a-z0-9]+', '_', 'g'), '_'),
        trim(regexp_replace(replace(lower(model), '+', '_plus_'), '[^a-z0-9]+', '_', 'g'), '_'),
        trim(regexp_replace(replace(lower(variant), '+', '_plus_'), '[^a-z0-9]+', '_', 'g'), '_')],
      lambda c: c <> ''), '_') AS want,
    CASE WHEN price_usd < 0 OR price_usd % 5 = 0 THEN CAST(price_usd AS DOUBLE)
         ELSE floor((price_usd + 2.5) / 5) * 5 END AS basis,
    list_filter(tags, lambda t: t IN """ + TIERS + r""") AS tiers,
    list_transform(files, lambda f, i: {'f': f, 'i': i - 1}) AS paths
  FROM cat),
parsed AS (
  SELECT *,
    list_transform(list_filter(['DD', 'BA', 'Planar', 'EST', 'MEMS', 'PZT', 'BC'],
        lambda k: len(list_filter(toks, lambda t: t.tech = k AND t.n > 0)) > 0),
      lambda k: {'tech': k, 'n': list_filter(toks, lambda t: t.tech = k AND t.n > 0)[-1].n}) AS parts,
    list_transform(list_filter(toks, lambda t: t.tech IS NULL OR coalesce(t.n, 0) <= 0), lambda t: t.raw) AS strange,
    CASE WHEN basis >= 1500 THEN 'Flagship' WHEN basis >= 500 THEN 'Premium' WHEN basis >= 100 THEN 'Mid-Tier'
         ELSE 'Budget' END AS tier,
    CASE WHEN id <> '' THEN id ELSE '(no id) #' || row_id END AS eid
  FROM base),
facts AS (
  SELECT *, len(parts) AS np,
    array_to_string(list_transform(parts, lambda p: p.n || p.tech), '+') AS canon,
    CASE WHEN len(parts) = 0 THEN '' WHEN len(parts) = 1 THEN parts[1].tech WHEN len(parts) = 2 THEN 'Hybrid'
         ELSE 'Tribrid' END AS kind2,
    CASE WHEN len(tiers) > 0 THEN
        list_filter(list_transform(tags, lambda t, i: CASE WHEN t NOT IN """ + TIERS + r""" THEN t
          WHEN i = list_position(tags, tiers[1]) THEN tier END), lambda t: t IS NOT NULL)
      ELSE list_append(tags, tier) END AS tags2
  FROM parsed)"""

# (category, code, severity, condition, fix) in the order the rules apply; NULL fix = none
ROW_RULES = [
    ("ID Format", "id-format", "warning", "want <> '' AND id <> want", "'id=' || want"),
    ("Driver Config", "dc-whitespace", "warning", "regexp_matches(driver_config, '\\s')",
     "'driver_config=' || CASE WHEN np > 0 THEN canon ELSE regexp_replace(driver_config, '\\s+', '', 'g') END"),
    ("Driver Config", "dc-unknown", "warning", "len(strange) > 0", "'driver_config=' || canon"),
    ("Driver Type", "dt-no-config", "error", "driver_type <> '' AND driver_config = ''", "'driver_type='"),
    ("Driver Type", "dt-no-type", "error", "driver_type = '' AND driver_config <> '' AND np > 0", "'driver_type=' || kind2"),
    ("Driver Type", "dt-mismatch", "warning", "driver_type <> '' AND driver_config <> '' AND np > 0 AND driver_type <> kind2",
     "'driver_type=' || kind2"),
    ("Driver Config", "dc-order", "info",
     "driver_type <> '' AND driver_config <> '' AND np > 0 AND regexp_replace(driver_config, '\\s+', '', 'g') <> canon",
     "'driver_config=' || canon"),
    ("Form/Connector Mismatch", "ff-missing", "error", "form_factor = ''", "NULL"),
    ("Form/Connector Mismatch", "ff-invalid", "error", "form_factor = 'Boombox'", "NULL"),
    ("Form/Connector Mismatch", "conn-missing", "error", "connector = ''", "NULL"),
    ("Form/Connector Mismatch", "conn-invalid", "error", "connector = 'USB'", "NULL"),
    ("Form/Connector Mismatch", "conn-matrix", "error",
     """connector NOT IN ('', 'USB') AND (
        (form_factor = 'IEM' AND connector NOT IN ('2-pin', 'QDC', 'MMCX', 'A2DC', 'Fixed Cable', 'Proprietary'))
        OR (form_factor = 'Wireless Earbuds (TWS)' AND connector <> 'Bluetooth')
        OR (form_factor = 'Over-Ear Headphones (Wired)'
            AND connector NOT IN ('Detachable Cable', 'Fixed Cable', 'Proprietary', 'Electrostatic')))""", "NULL"),
    ("Spec Sanity", "spec-negative", "error", "impedance < 0", "'impedance=0'"),
    ("Spec Sanity", "spec-range", "warning",
     "impedance > CASE WHEN connector = 'Electrostatic' OR driver_type = 'EST' THEN 360000 ELSE 200000 END", "NULL"),
    ("Spec Sanity", "spec-range", "warning", "sensitivity > 200", "NULL"),
    ("Price Tier Tag", "price-tier-tag", "warning", "tiers <> [tier]", "'tags=' || array_to_string(tags2, ',')"),
    ("Price Rounding", "price-negative", "error", "price_usd < 0", "NULL"),
    ("Price Rounding", "price-rounding", "warning", "price_usd > 0 AND price_usd % 5 <> 0",
     "'price_usd=' || CAST(floor((price_usd + 2.5) / 5) * 5 AS BIGINT)"),
    ("Year", "year", "error", f"year <> 0 AND (year < 1950 OR year > {LAST_YEAR})", "NULL"),
    ("Missing Field", "brand-missing", "error", "trim(brand) = ''", "NULL"),
    ("Missing Data", "year-unknown", "warning", "year = 0", "NULL"),
    ("Missing Data", "price-unknown", "warning", "price_usd = 0", "NULL"),
    ("Missing Data", "drivers-unknown", "warning", "driver_type = '' AND driver_config = ''", "NULL"),
    ("Missing Data", "impedance-unknown", "warning", "form_factor <> 'Wireless Earbuds (TWS)' AND impedance = 0", "NULL"),
    ("Missing Data", "sensitivity-unknown", "warning", "form_factor <> 'Wireless Earbuds (TWS)' AND sensitivity = 0", "NULL"),
    ("Missing Data", "tws-nonzero", "warning",
     "form_factor = 'Wireless Earbuds (TWS)' AND (impedance <> 0 OR sensitivity <> 0)", "NULL"),
    ("Tag Count", "tag-count", "error", "len(tags) < 4", "NULL"),
    ("Duplicate Tag", "duplicate-tag", "error", "len(list_distinct(tags)) < len(tags)", "NULL"),
    ("Unapproved Tag", "unapproved-tag", "error", "list_contains(tags, 'Loud')", "NULL"),
    ("Duplicate File", "duplicate-file", "error", "len(list_distinct(files)) < len(files)", "NULL"),
    ("Tag Conflict", "tag-conflict", "error", "list_contains(tags, 'Neutral') AND list_contains(tags, 'V-Shaped')", "NULL"),
    ("Tag Conflict", "tag-conflict", "error", "list_contains(tags, 'Bright') AND list_contains(tags, 'Warm')", "NULL"),
    ("Tag Conflict", "tag-conflict", "error", "list_contains(tags, 'Balanced') AND list_contains(tags, 'U-Shaped')", "NULL"),
]
PATH_RULES = [
    ("file-empty", "error", "trim(p.f) = ''", "'files[' || p.i || ']=-'"),
    ("file-ws", "error", "trim(p.f) <> '' AND p.f <> trim(p.f)", "'files[' || p.i || ']=' || trim(p.f)"),
    ("file-backslash", "warning", "trim(p.f) <> '' AND contains(p.f, chr(92))",
     "'files[' || p.i || ']=' || replace(p.f, chr(92), '/')"),
    ("file-traversal", "error", "trim(p.f) <> '' AND list_contains(string_split(p.f, '/'), '..')", "NULL"),
]
ISSUES = FACTS + ", issues AS (" + "\nUNION ALL ".join(
    f"SELECT row_id, eid AS entry_id, '{cat}' AS category, '{code}' AS code, '{sev}' AS severity, eid AS subject, "
    f"CAST({fix} AS VARCHAR) AS fix FROM facts WHERE {cond}"
    for cat, code, sev, cond, fix in ROW_RULES
) + "\nUNION ALL " + "\nUNION ALL ".join(
    f"SELECT row_id, eid, 'File Path', '{code}', '{sev}', eid, CAST({fix} AS VARCHAR) FROM "
    f"(SELECT row_id, eid, unnest(paths) AS p FROM facts) WHERE {cond}"
    for code, sev, cond, fix in PATH_RULES
) + ")"


def part_catalog(spark, sf):
    return table(spark, sf, "part").selectExpr(*columns(PART, spark_sql))


def disk_files(spark, sf):
    part = table(spark, sf, "part")
    by_name = part.selectExpr("'data/' || p_brand || '/' || p_name || '.txt' AS path")
    by_key = part.selectExpr("CASE WHEN p_size > 4 THEN 'data/' ELSE 'spare/' END || p_brand || '/' || CAST(p_partkey AS STRING) || '.txt' AS path")
    return by_name.union(by_key).distinct()


def part_issues(spark, sf):
    return A.audit_rows(part_catalog(spark, sf), last_year=LAST_YEAR)


@query("audit_rules", f"WITH {ISSUES} SELECT row_id, entry_id, category, code, severity, subject, fix FROM issues")
def audit_rules(spark, sf):
    return part_issues(spark, sf).select(
        "row_id", "entry_id", "category", "code", "severity", "subject",
        F.when(F.col("fix").isNotNull(), fix_text()).alias("fix"),
    )


@query("audit_summary", f"""WITH {ISSUES}
SELECT category, code, count(*) AS live, count(*) FILTER (severity = 'error') AS errors,
  count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos,
  CAST(0 AS BIGINT) AS ignored, count(fix) AS fixable
FROM issues GROUP BY ALL""")
def audit_summary(spark, sf):
    return I.issue_summary(part_issues(spark, sf))


TABLE_ISSUES = CAT + f""", disk AS ({DISK}),
disk2 AS (SELECT lower(path) AS fold, max(path) AS disk FROM disk GROUP BY 1),
ids AS (SELECT *, CASE WHEN id <> '' THEN id ELSE '(no id) #' || row_id END AS eid FROM cat),
raw AS (SELECT row_id, eid, unnest(files) AS f, generate_subscripts(files, 1) - 1 AS pos FROM ids),
link AS (SELECT *, lower(path) AS fold FROM (
  SELECT row_id, eid, f, pos, regexp_replace(trim(replace(f, chr(92), '/')), '/+', '/', 'g') AS path FROM raw) WHERE path <> ''),
spell AS (SELECT regexp_replace(lower(brand), '[^a-z0-9]', '', 'g') AS fold, trim(brand) AS s, count(*) AS n
  FROM cat WHERE trim(brand) <> '' GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY n DESC, s) AS k,
  first_value(s) OVER (PARTITION BY fold ORDER BY n DESC, s) AS canon,
  max(n) OVER (PARTITION BY fold) AS top FROM spell),
tie AS (SELECT fold, count(*) AS at_top FROM ranked WHERE n = top GROUP BY 1),
off AS (SELECT s, canon, at_top = 1 AS clear FROM ranked JOIN tie USING (fold) WHERE k > 1),
unused AS (SELECT path FROM disk WHERE path NOT IN (SELECT path FROM link)),
issues AS (
SELECT row_id, id AS entry_id, 'duplicate-id' AS code, 'error' AS severity, id || '@' || row_id AS subject, '' AS fix
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_id) AS k FROM cat WHERE id <> '') WHERE k > 1
UNION ALL SELECT row_id, eid, 'brand-spelling', 'warning', eid,
  CASE WHEN clear THEN 'brand=' || canon || ';id=' || array_to_string(list_filter([
     regexp_replace(lower(canon), '[^a-z0-9]+', '_', 'g'), replace(model, ' ', '_'), variant], lambda c: c <> ''), '_') ELSE '' END
  FROM ids JOIN off ON trim(brand) = s
UNION ALL SELECT row_id, eid, 'duplicate-file-link', 'warning', path || '@' || row_id, ''
  FROM link WHERE path IN (SELECT path FROM link GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT DISTINCT row_id, eid, 'duplicate-file-ci', 'warning', fold || '@' || row_id, ''
  FROM link WHERE fold IN (SELECT fold FROM link GROUP BY 1 HAVING count(DISTINCT path) > 1 AND count(DISTINCT row_id) > 1)
UNION ALL SELECT row_id, eid, 'path-casing', 'warning', eid, string_agg('files[' || pos || ']=' || disk, ';' ORDER BY pos)
  FROM raw JOIN disk2 ON lower(f) = fold WHERE f <> disk GROUP BY row_id, eid
UNION ALL SELECT DISTINCT row_id, eid, 'missing-file', 'error', eid, path FROM link WHERE fold NOT IN (SELECT fold FROM disk2)
UNION ALL SELECT NULL, '(none)', 'unlinked-file', 'info', path, '' FROM unused
UNION ALL SELECT NULL, '(none)', 'unlinked-file', 'info', '(none)', '' FROM unused HAVING count(*) > 0)"""


@query("audit_tables", f"WITH {TABLE_ISSUES} SELECT row_id, entry_id, code, severity, subject, fix FROM issues")
def audit_tables(spark, sf):
    """Rules that need several rows: ids, brand spellings, links and the files that exist."""
    catalog, files = part_catalog(spark, sf), disk_files(spark, sf)
    parts = A.audit_identity(catalog) + A.audit_links(catalog, files)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    gone = F.col("code") == "missing-file"
    return out.select(
        "row_id", "entry_id", "code", "severity", "subject",
        F.when(gone, F.substring_index("message", "not found: ", -1)).otherwise(F.coalesce(fix_text(), F.lit(""))).alias("fix"),
    )


# waivers are derived from the issues themselves: all price tiers, and every other kind for even rows
WAIVERS = """SELECT DISTINCT subject || '|' || category || '|' || code AS waiver_key FROM issues
  WHERE code = 'price-tier-tag' OR row_id % 2 = 0"""


@query("waived_issues", f"""WITH {ISSUES}, waivers AS ({WAIVERS})
SELECT row_id, code, severity, subject, CASE WHEN severity <> 'error'
  AND subject || '|' || category || '|' || code IN (SELECT waiver_key FROM waivers) THEN 1 ELSE 0 END AS waived FROM issues""")
def waived_issues(spark, sf):
    # read four times below
    issues = written(part_issues(spark, sf).select("row_id", "category", "code", "severity", "subject"))
    keys = issues.where("code = 'price-tier-tag' OR row_id % 2 = 0").select(I.waiver_key().alias("waiver_key")).distinct()
    live = I.waive(issues, keys).withColumn("waived", F.lit(0))
    hidden = I.waive(issues, keys, invert=True).withColumn("waived", F.lit(1))
    return live.unionByName(hidden).select("row_id", "code", "severity", "subject", "waived")


@query("issues_by_entry", f"""WITH {ISSUES}, waivers AS ({WAIVERS})
SELECT entry_id, row_id, count(*) AS n_issues,
  count(*) FILTER (severity <> 'error' AND subject || '|' || category || '|' || code IN (SELECT waiver_key FROM waivers)) AS n_ignored,
  count(fix) AS n_fixable,
  CASE min(CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END)
    WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS worst
FROM issues GROUP BY entry_id, row_id""")
def issues_by_entry(spark, sf):
    issues = written(part_issues(spark, sf))  # read twice below
    keys = issues.where("code = 'price-tier-tag' OR row_id % 2 = 0").select(I.waiver_key().alias("waiver_key")).distinct()
    return I.issues_by_entry(issues, keys).drop("message")


@query("validate", f"""WITH {FACTS},
dup AS (SELECT id FROM cat WHERE id <> '' GROUP BY 1 HAVING count(*) > 1)
SELECT row_id,
  (trim(brand) = '')::INT + (id <> want)::INT
  + (year <> 0 AND (year < 1950 OR year > {LAST_YEAR}))::INT + (price_usd < 0)::INT
  + (price_usd >= 0 AND price_usd % 5 <> 0)::INT + (form_factor IN ('', 'Boombox'))::INT + (connector IN ('', 'USB'))::INT
  + (connector NOT IN ('', 'USB') AND (
        (form_factor = 'IEM' AND connector NOT IN ('2-pin', 'MMCX'))
        OR (form_factor = 'Wireless Earbuds (TWS)' AND connector <> 'Bluetooth')
        OR (form_factor = 'Over-Ear Headphones (Wired)' AND connector NOT IN ('Detachable Cable', 'Electrostatic'))))::INT
  + (driver_config LIKE '% %')::INT + (driver_type <> '' AND driver_config = '')::INT
  + (driver_type = '' AND np > 0)::INT + (len(strange) > 0)::INT + (np > 0 AND kind2 <> driver_type)::INT
  + (impedance < 0)::INT + (len(list_distinct(tags)) < len(tags))::INT + (list_contains(tags, 'Loud'))::INT + (len(tags) < 4)::INT
  + (list_contains(tags, 'Neutral') AND list_contains(tags, 'V-Shaped'))::INT
  + (list_contains(tags, 'Bright') AND list_contains(tags, 'Warm'))::INT
  + (list_contains(tags, 'Balanced') AND list_contains(tags, 'U-Shaped'))::INT
  + (len(tiers) <> 1)::INT + (len(tiers) = 1 AND tiers[1] <> tier)::INT
  + (id IN (SELECT id FROM dup))::INT AS n_errors
FROM facts""")
def validate(spark, sf):
    checked = V.validate(part_catalog(spark, sf), last_year=LAST_YEAR)
    return checked.select("row_id", F.size("errors").alias("n_errors"))


# last write per field; ids settle by row order and are free only when every row that held them has left; a refused id
# leaves the row's other fixes as they are
@query("apply_fixes", f"""WITH RECURSIVE {FACTS},
moved AS (SELECT row_id, id AS old_id, want FROM facts WHERE want <> '' AND id <> want),
held AS (SELECT id, count(*) AS holders FROM cat WHERE id <> '' GROUP BY 1),
free AS (SELECT old_id AS id, count(*) AS leavers, max(row_id) AS freed_by FROM moved GROUP BY 1),
win AS (SELECT m.want, min(m.row_id) AS row_id, bool_or(h.id IS NOT NULL) AS waits FROM moved m LEFT JOIN held h ON h.id = m.want
  LEFT JOIN free f ON f.id = m.want WHERE h.id IS NULL OR (f.leavers = h.holders AND f.freed_by < m.row_id) GROUP BY 1),
needs AS (SELECT w.row_id, m.row_id AS other FROM win w JOIN moved m ON m.old_id = w.want WHERE w.waits),
lost AS (SELECT row_id FROM needs WHERE other NOT IN (SELECT row_id FROM win)
  UNION SELECT n.row_id FROM needs n JOIN lost l ON l.row_id = n.other),
gain AS (SELECT row_id FROM win WHERE row_id NOT IN (SELECT row_id FROM lost))
SELECT row_id,
  CASE WHEN want <> '' AND row_id IN (SELECT row_id FROM gain) THEN want ELSE id END AS id,
  CASE WHEN driver_config = '' THEN '' WHEN np > 0 THEN kind2 ELSE driver_type END AS driver_type,
  CASE WHEN np > 0 AND (driver_type <> '' OR driver_config LIKE '% %' OR len(strange) > 0) THEN canon
       WHEN len(strange) > 0 THEN canon ELSE driver_config END AS driver_config,
  CASE WHEN impedance < 0 THEN 0 ELSE impedance END AS impedance,
  CASE WHEN price_usd > 0 AND price_usd % 5 <> 0 THEN CAST(floor((price_usd + 2.5) / 5) * 5 AS INT) ELSE price_usd END AS price_usd,
  array_to_string(CASE WHEN tiers <> [tier] THEN tags2 ELSE tags END, ',') AS tags,
  array_to_string(list_transform(list_filter(files, lambda f: trim(f) <> ''), lambda f:
    CASE WHEN f <> trim(f) THEN trim(f) ELSE replace(f, chr(92), '/') END), ',') AS files
FROM facts""")
def fixes(spark, sf):
    catalog = part_catalog(spark, sf)
    after, _, _ = apply_fixes(catalog, part_issues(spark, sf), last_year=LAST_YEAR)
    return after.select(
        "row_id", "id", "driver_type", "driver_config", "impedance", "price_usd",
        show_list("tags").alias("tags"), show_list("files").alias("files"),
    )


NORM = r"""trim(regexp_replace(replace(lower(regexp_replace(strip_accents({0}), '[^\x00-\x7F]', '', 'g')), '+', '_plus_'),
  '[^a-z0-9]+', '_', 'g'), '_')"""


@query("build_id", f"""WITH w AS (SELECT doc_id, split_part(text, ' ', 1) AS a, text AS b, lang FROM documents)
SELECT doc_id, md5(array_to_string(list_filter([
  CASE WHEN {NORM.format('a')} <> '' THEN {NORM.format('a')} WHEN trim(a) <> '' THEN 'x' || substr(sha1(a), 1, 6) ELSE '' END,
  CASE WHEN {NORM.format('b')} <> '' THEN {NORM.format('b')} WHEN trim(b) <> '' THEN 'x' || substr(sha1(b), 1, 6) ELSE '' END,
  lang], lambda c: c <> ''), '_')) AS id_md5 FROM w""")
def build_id(spark, sf):
    """Ids out of first word, whole text and language."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(fn.build_id(F.split_part("text", F.lit(" "), F.lit(1)), "text", "lang")).alias("id_md5"))


@query("brand_fold", r"""SELECT doc_id,
  md5(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]', '', 'g')) AS fold_md5
FROM documents""")
def brand_fold(spark, sf):
    """The fold of whole texts, compared by digest."""
    return table(spark, sf, "documents").select("doc_id", F.md5(fn.brand_fold("text")).alias("fold_md5"))


@query("round_to_5", """SELECT o_orderkey, o_totalprice,
  CASE WHEN o_totalprice > 0 THEN CAST(floor((o_totalprice + 2.5) / 5.0) * 5 AS BIGINT) ELSE 0 END AS rounded,
  CASE WHEN o_totalprice - 200000 > 0 THEN CAST(floor((o_totalprice - 200000 + 2.5) / 5.0) * 5 AS BIGINT) ELSE 0 END AS shifted
FROM orders""")
def round_to_5(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        "o_orderkey", "o_totalprice", fn.round_to_5("o_totalprice").alias("rounded"),
        fn.round_to_5(F.col("o_totalprice") - 200000).alias("shifted"),
    )


@query("price_tier", """WITH b AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 40 AS p FROM lineitem),
c AS (SELECT *, CASE WHEN p < 0 OR p % 5 = 0 THEN p ELSE floor((p + 2.5) / 5.0) * 5 END AS basis FROM b)
SELECT CASE WHEN p >= 1500 THEN 'Flagship' WHEN p >= 500 THEN 'Premium' WHEN p >= 100 THEN 'Mid-Tier' ELSE 'Budget' END AS tier,
  CASE WHEN basis >= 1500 THEN 'Flagship' WHEN basis >= 500 THEN 'Premium' WHEN basis >= 100 THEN 'Mid-Tier' ELSE 'Budget' END AS expected,
  count(*) AS n, min(basis) AS lo, max(basis) AS hi FROM c GROUP BY 1, 2""")
def price_tier(spark, sf):
    p = table(spark, sf, "lineitem").select((F.col("l_extendedprice") / 40).alias("p")).withColumn("basis", fn.tier_basis("p"))
    return p.groupBy(fn.price_tier("p").alias("tier"), fn.price_tier("basis").alias("expected")).agg(
        F.count("*").alias("n"), F.min("basis").alias("lo"), F.max("basis").alias("hi")
    )


MONEY = """CASE WHEN l_linenumber = 1 THEN '$' || CAST(CAST(l_quantity AS INT) AS STRING) || ',' || lpad(CAST(l_partkey % 1000 AS STRING), 3, '0')
  WHEN l_linenumber = 2 THEN CAST(CAST(l_quantity AS INT) AS STRING) || ' ohm'
  WHEN l_linenumber = 3 THEN CAST(CAST(l_quantity AS INT) AS STRING) || '.5 dB'
  WHEN l_linenumber = 4 THEN CAST(CAST(l_quantity AS INT) AS STRING) || ',5'
  WHEN l_linenumber = 5 THEN '1_' || CAST(l_partkey AS STRING)
  WHEN l_linenumber = 6 THEN ' -' || CAST(CAST(l_quantity AS INT) AS STRING) || '.25 '
  ELSE CAST(l_partkey AS STRING) || 'f' END"""


@query("coerce_int", f"""WITH t AS (SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, {duck_sql(MONEY)} AS raw FROM lineitem)
SELECT raw, count(*) AS n, CAST(min(CASE WHEN l_linenumber = 1 THEN CAST(l_quantity AS INT) * 1000 + l_partkey % 1000
  WHEN l_linenumber = 2 THEN CAST(l_quantity AS INT) WHEN l_linenumber = 3 THEN CAST(l_quantity AS INT) + 1
  WHEN l_linenumber = 6 THEN floor(-CAST(l_quantity AS INT) - 0.25 + 0.5) ELSE 0 END) AS BIGINT) AS value
FROM t GROUP BY raw""")
def coerce_int(spark, sf):
    t = table(spark, sf, "lineitem").selectExpr(f"{spark_sql(MONEY)} AS raw")
    return t.groupBy("raw").agg(F.count("*").alias("n")).select("raw", "n", fn.coerce_int("raw").alias("value"))


CONFIG = """CAST(l_linenumber AS STRING) || CASE WHEN l_returnflag = 'A' THEN 'ba' WHEN l_returnflag = 'N' THEN 'DD' ELSE 'planar' END
  || CASE WHEN l_linestatus = 'F' THEN ' + ' ELSE '+' END || CAST(CAST(l_quantity AS INT) % 4 AS STRING) || 'EST'
  || CASE WHEN l_linenumber > 4 THEN '+' || CAST(CAST(l_quantity AS INT) % 3 AS STRING) || 'DD' ELSE '' END
  || CASE WHEN l_tax > 0.06 THEN '+xx' ELSE '' END"""


@query("parse_driver_config", f"""WITH raw AS (SELECT {duck_sql(CONFIG)} AS config, count(*) AS n FROM lineitem GROUP BY 1),
toks AS (SELECT config, n, list_filter(string_split(replace(config, ' ', ''), '+'), lambda t: t <> '') AS t FROM raw),
one AS (SELECT config, n, unnest(t) AS tok, generate_subscripts(t, 1) AS pos FROM toks),
read AS (SELECT *, TRY_CAST(regexp_extract(tok, '^(\\d+)([A-Za-z]+)$', 1) AS BIGINT) AS k,
  list_position(['DD', 'BA', 'PLANAR', 'EST', 'MEMS', 'PZT', 'BC'], upper(regexp_extract(tok, '^(\\d+)([A-Za-z]+)$', 2))) AS tech FROM one),
last AS (SELECT config, tech, arg_max(k, pos) AS k FROM read WHERE tech IS NOT NULL AND k > 0 GROUP BY 1, 2),
canon AS (SELECT config, count(*) AS nt, min(tech) AS tech1, string_agg(k || ['DD', 'BA', 'Planar', 'EST', 'MEMS', 'PZT', 'BC'][tech], '+' ORDER BY tech) AS canonical
  FROM last GROUP BY 1),
odd AS (SELECT config, string_agg(tok, ',' ORDER BY pos) AS unknown FROM read WHERE tech IS NULL OR coalesce(k, 0) <= 0 GROUP BY 1)
SELECT config, n, coalesce(canonical, '') AS canonical,
  CASE WHEN nt IS NULL THEN '' WHEN nt = 1 THEN ['DD', 'BA', 'Planar', 'EST', 'MEMS', 'PZT', 'BC'][tech1] WHEN nt = 2 THEN 'Hybrid' ELSE 'Tribrid' END AS kind,
  coalesce(unknown, '') AS unknown
FROM raw LEFT JOIN canon USING (config) LEFT JOIN odd USING (config)""")
def parse_driver_config(spark, sf):
    c = table(spark, sf, "lineitem").selectExpr(f"{spark_sql(CONFIG)} AS config").groupBy("config").agg(F.count("*").alias("n"))
    c = c.withColumn("d", fn.classify_driver(fn.driver_parts("config")))
    return c.select(
        "config", "n", F.col("d.config").alias("canonical"), F.col("d.type").alias("kind"),
        show_list(fn.unknown_driver_tokens("config")).alias("unknown"),
    )


TAG_OF = """CASE WHEN value >= 20 THEN 'Detailed' WHEN event_type = 'click' THEN 'Warm' WHEN event_type = 'view' THEN 'Bright'
  WHEN event_type = 'error' THEN 'Neutral' WHEN event_type = 'purchase' THEN 'V-Shaped' ELSE 'Basshead' END"""


@query("tag_conflicts", f"""WITH t AS (SELECT user_id, list_sort(list(DISTINCT {TAG_OF})) AS tags FROM events GROUP BY 1),
c AS (SELECT user_id, 1 AS k, 'Neutral + V-Shaped' AS pair FROM t WHERE list_contains(tags, 'Neutral') AND list_contains(tags, 'V-Shaped')
  UNION ALL SELECT user_id, 2, 'Bright + Warm' FROM t WHERE list_contains(tags, 'Warm') AND list_contains(tags, 'Bright'))
SELECT user_id, array_to_string(tags, ',') AS tags, coalesce((SELECT string_agg(pair, ';' ORDER BY k) FROM c WHERE c.user_id = t.user_id), '') AS conflicts FROM t""")
def tag_conflicts(spark, sf):
    e = table(spark, sf, "events").selectExpr("user_id", f"{TAG_OF} AS tag")
    t = e.groupBy("user_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    found = F.transform(fn.tag_conflicts("tags"), lambda c: c["pair"])
    return t.select("user_id", show_list("tags").alias("tags"), F.array_join(found, ";").alias("conflicts"))


URL = "CASE WHEN page_id % 4 = 0 THEN ' ./' || url WHEN page_id % 4 = 1 THEN replace(url, '/', chr(92)) || '/./x' ELSE url END"


@query("path_normalize", f"""WITH u AS (SELECT page_id, {URL} AS raw FROM pages),
n AS (SELECT page_id, raw, replace(regexp_replace(regexp_replace(trim(replace(raw, chr(92), '/')), '/+', '/', 'g'), '^(\\./)+', ''), '/./', '/') AS path FROM u)
SELECT page_id, path, (trim(raw) <> '' AND NOT starts_with(trim(replace(raw, chr(92), '/')), '/') AND NOT regexp_matches(trim(raw), '^[A-Za-z]:')
  AND NOT list_contains(string_split(trim(replace(raw, chr(92), '/')), '/'), '..')) AS safe FROM n""")
def path_normalize(spark, sf):
    u = table(spark, sf, "pages").selectExpr("page_id", f"{URL} AS raw")
    return u.select("page_id", fn.normalize_path("raw").alias("path"), fn.safe_path("raw").alias("safe"))


# every event's properties as a raw entry: the key is unknown, prices come as text
@query("clean_notes", """WITH r AS (SELECT event_id, event_type, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k, value FROM events)
SELECT event_id, CAST(CASE WHEN event_type = 'click' THEN floor(value + 0.5) ELSE k END AS INT) AS price_usd, trim(event_type) AS brand,
  CAST(1 + CASE WHEN event_type = 'click' AND contains(CAST(value AS VARCHAR), '.') THEN 1 WHEN event_type = 'view' THEN 1 ELSE 0 END AS BIGINT) AS n_notes
FROM r""")
def clean_notes(spark, sf):
    """A2 over events: unknown key dropped, values coerced, notes counted per entry."""
    e = table(spark, sf, "events")
    k = F.regexp_extract("props", r"(\d+)", 1)
    price = F.when(F.col("event_type") == "click", F.col("value").cast("string")).when(
        F.col("event_type") == "view", F.concat(F.lit("$"), k)
    ).otherwise(k)
    raw = e.select(
        F.col("event_id").alias("row_id"),
        F.map_concat(
            F.from_json("props", "map<string,string>"),
            F.create_map(F.lit("price_usd"), price, F.lit("brand"), F.concat(F.lit(" "), F.col("event_type"))),
        ).alias("raw"),
    )
    catalog, notes = clean_catalog(raw, hints=False)
    per = notes.groupBy("row_id").agg(F.count("*").alias("n_notes"))
    return catalog.join(per, "row_id", "left").select(
        F.col("row_id").alias("event_id"), "price_usd", "brand", F.coalesce("n_notes", F.lit(0)).alias("n_notes")
    )


# positions in catalog order; what reading cleans
ARRAY = f"""WITH {CAT} SELECT row_number() OVER (ORDER BY lower(brand), lower(model), lower(variant), row_id) - 1 AS row_id, id, brand, model,
  variant, year, price_usd, driver_config, impedance, connector, array_to_string(tags, ',') AS tags,
  array_to_string(list_filter(list_transform(files, lambda f: trim(f)), lambda f: f <> ''), ',') AS files FROM cat"""


def _array_again(spark, sf, name, compression=None):
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    write_catalog(part_catalog(spark, sf), path, "json", compression)
    catalog, _ = clean_catalog(read_catalog(spark, path, "json-parts"), hints=False)
    return catalog.select(
        "row_id", "id", "brand", "model", "variant", "year", "price_usd", "driver_config", "impedance", "connector",
        show_list("tags").alias("tags"), show_list("files").alias("files"),
    )


@query("catalog_array", ARRAY)
def catalog_array(spark, sf):
    """A7, A1: the catalog as one JSON array, written and read by ranges."""
    return _array_again(spark, sf, "catalog-array")


@query("catalog_array_gzip", ARRAY)
def catalog_array_gzip(spark, sf):
    """A8, A1: the same with gzip members laid end to end."""
    return _array_again(spark, sf, "catalog-gzip", "gzip")


@query("search_filter", f"""WITH {CAT} SELECT row_id, brand, model, price_usd FROM cat
WHERE contains(lower(brand || ' ' || model || ' ' || variant || ' ' || id), 'ring')
  AND price_usd BETWEEN 100 AND 900 AND year > 1960 AND len(list_filter(tags, lambda t: contains(lower(t), 'warm'))) > 0""")
def search_filter(spark, sf):
    return part_catalog(spark, sf).where(fn.search("Ring price:100-900 year:>1960 tag:warm")).select(
        "row_id", "brand", "model", "price_usd"
    )


@query("suggest_values", f"""WITH {CAT}, hit AS (SELECT model, max(lower(brand) = 'brand#7') AS near FROM cat
  WHERE model <> '' AND contains(lower(model), 'red') GROUP BY 1)
SELECT model AS value FROM hit WHERE near OR NOT (SELECT max(near) FROM hit)""")
def suggest_values(spark, sf):
    return L.suggest_values(part_catalog(spark, sf), "model", "red", prefer=("brand", "Brand#7"))


@query("brand_counts", f"""WITH {CAT} SELECT brand, count(*) AS n FROM cat WHERE contains(lower(form_factor), 'iem') GROUP BY 1""")
def brand_counts(spark, sf):
    return L.brand_counts(part_catalog(spark, sf), "ff:iem")


@query("find_replace", f"""WITH {CAT},
t AS (SELECT row_id, 'model' AS field, model AS old, replace(model, 'ring', 'R$1') AS new FROM cat),
f AS (SELECT row_id, 'files' AS field, array_to_string(files, ',') AS old,
  array_to_string(list_transform(files, lambda f: regexp_replace(f, 'data/', 'media/', 'gi')), ',') AS new FROM cat),
x AS (SELECT row_id, 'driver_config' AS field, driver_config AS old, regexp_replace(driver_config, '(\\d)BA', 'BA\\1', 'g') AS new FROM cat),
a AS (SELECT * FROM t UNION ALL SELECT * FROM f UNION ALL SELECT * FROM x)
SELECT * FROM a WHERE old <> new""")
def find_replace_query(spark, sf):
    c = part_catalog(spark, sf)
    text = find_replace(c, "model", "ring", "R$1").withColumn("field", F.lit("model"))
    files = find_replace(c, "files", "data/", "media/").select(
        "row_id", show_list("old").alias("old"), show_list("new").alias("new"), F.lit("files").alias("field")
    )
    regex = find_replace(c, "driver_config", r"(\d)BA", r"BA\1", mode="regex", case_sensitive=True).withColumn(
        "field", F.lit("driver_config")
    )
    return text.unionByName(files).unionByName(regex).select("row_id", "field", "old", "new")


@query("rename_tag", f"""WITH {CAT},
r AS (SELECT row_id, 'rename' AS what, tags, list_transform(tags, lambda t: CASE WHEN t = 'Fun' THEN 'Premium' ELSE t END) AS n FROM cat),
d AS (SELECT row_id, what, tags, list_filter(n, lambda t, i: list_position(n, t) = i) AS new FROM r WHERE list_contains(tags, 'Fun')
  UNION ALL SELECT row_id, 'remove', tags, list_filter(tags, lambda t: t <> 'Loud') FROM cat WHERE list_contains(tags, 'Loud'))
SELECT row_id, what, array_to_string(tags, ',') AS old, array_to_string(new, ',') AS new FROM d""")
def rename_tag_query(spark, sf):
    c = part_catalog(spark, sf)
    both = rename_tag(c, "Fun", "Premium").withColumn("what", F.lit("rename")).unionByName(
        rename_tag(c, "Loud", "").withColumn("what", F.lit("remove"))
    )
    return both.select("row_id", "what", show_list("old").alias("old"), show_list("new").alias("new"))


@query("missing_spec_gate", f"""WITH {CAT} SELECT form_factor, count(*) AS n,
  count(*) FILTER (form_factor <> 'Wireless Earbuds (TWS)' AND (impedance = 0 OR sensitivity = 0)) AS needs_confirm FROM cat GROUP BY 1""")
def missing_spec_gate(spark, sf):
    return L.missing_spec_gate(part_catalog(spark, sf)).groupBy("form_factor").agg(
        F.count("*").alias("n"), F.count_if("needs_confirm").alias("needs_confirm")
    )


@query("entry_label", f"""WITH {CAT} SELECT row_id, CASE WHEN variant <> '' THEN trim(brand || ' ' || model) || '  [' || variant || ']'
  ELSE trim(brand || ' ' || model) END AS label FROM cat""")
def entry_label(spark, sf):
    return part_catalog(spark, sf).select("row_id", fn.entry_label("brand", "model", "variant", "id").alias("label"))


__all__ = ["part_catalog", "disk_files", "PART", "CAT", "FACTS"]
