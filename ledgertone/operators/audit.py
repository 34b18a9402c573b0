"""Audit rules: a catalog in, a table of issues with their fixes out.

All rules about one row are one projection over one scan; rules about several rows are
aggregates joined back and united with it.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.numbers import year_max
from ..functions.text import build_id, strip, text
from . import duplicates, links
from .facts import BAD_CONNECTOR, quoted, says, with_facts
from .spelling import spelling_fixes

FIX_TYPE = S.FIX.simpleString()
ISSUE = ("row_id", "entry_id", "category", "code", "severity", "subject", "message", "fix", "fix_order", "key_b", "confidence")


def no_fix() -> Column:
    return F.lit(None).cast(S.FIX)


def set_value(field: str, value) -> Column:
    value = F.lit(value) if isinstance(value, str) else value.cast("string")
    return F.struct(
        F.lit(field).alias("field"), F.lit(None).cast("int").alias("pos"), value.alias("value"),
        F.lit(None).cast("array<string>").alias("items"),
    )


def set_element(field: str, pos, value) -> Column:
    return F.struct(
        F.lit(field).alias("field"), pos.cast("int").alias("pos"), value.cast("string").alias("value"),
        F.lit(None).cast("array<string>").alias("items"),
    )


def slug(category: str) -> str:
    return category.lower().replace(" ", "-")


def _rules(enforce_tws: bool, last_year: int | None) -> list[tuple]:
    """(category, code, severity, condition, message, fix) in the order fixes apply.

    Conditions and fix values are SQL over the columns of ``with_facts``; a fix is a list of
    (field, value).
    """
    last = last_year or year_max()
    canon, kind = "_driver.config", "_driver.type"
    parsed, both = "size(_parts) > 0", "_kind <> '' AND _config <> '' AND size(_parts) > 0"
    pairing, missing = "Form/Connector Mismatch", "Missing Data"
    tws = f"_form = '{S.TWS}'"
    loaded = "(NOT _impedance <=> 0D OR NOT _sensitivity <=> 0D)"
    rules = [
        ("ID Format", None, "warning", "_want <> '' AND NOT id <=> _want", says("id should be ", "=_want"), [("id", "_want")]),
        *[
            ("ID Format", "id-nonlatin", "warning", f"array_contains(_nonlatin, '{f}')",
             says(f"{f} has no Latin spelling: ", f"=_{f}"), None)
            for f in ("brand", "model", "variant")
        ],
        ("Driver Config", "dc-whitespace", "warning", "_blanks", says("driver_config has blanks: ", "=driver_config"),
         [("driver_config", f"CASE WHEN {parsed} THEN {canon} ELSE _tight END")]),
        ("Driver Config", "dc-unknown", "warning", "size(_strange) > 0",
         says("unknown driver tokens: ", "=array_join(_strange, ', ')"), [("driver_config", canon)]),
        ("Driver Type", "dt-no-config", "error", "_kind <> '' AND _config = ''", says("driver_type without driver_config"),
         [("driver_type", "''")]),
        ("Driver Type", "dt-no-type", "error", f"_kind = '' AND _config <> '' AND {parsed}",
         says("driver_type should be ", f"={kind}"), [("driver_type", kind)]),
        ("Driver Type", "dt-mismatch", "warning", f"{both} AND _kind <> {kind}", says("driver_type should be ", f"={kind}"),
         [("driver_type", kind)]),
        ("Driver Config", "dc-order", "info", f"{both} AND _tight <> {canon}", says("driver_config should be ", f"={canon}"),
         [("driver_config", canon)]),
        (pairing, "ff-missing", "error", "_form = ''", says("form factor is missing"), None),
        (pairing, "ff-invalid", "error", f"_form <> '' AND _form NOT IN ({quoted(S.FORM_FACTORS)})",
         says("unknown form factor: ", "=_form"), None),
        (pairing, "conn-missing", "error", "_conn = ''", says("connector is missing"), None),
        (pairing, "conn-invalid", "error", f"_conn <> '' AND _conn NOT IN ({quoted(S.CONNECTORS)})",
         says("unknown connector: ", "=_conn"), None),
        (pairing, "conn-matrix", "error", BAD_CONNECTOR, says("connector ", "=_conn", " does not fit ", "=_form"), None),
    ]
    if enforce_tws:
        rules.append(
            ("TWS Specs", None, "error", f"{tws} AND {loaded}", says("wireless earbuds have no impedance or sensitivity"),
             [("impedance", "'0'"), ("sensitivity", "'0'")])
        )
    electrostatic = "(_conn = 'Electrostatic' OR _kind = 'EST')"
    for f, cap in (
        ("impedance", f"CASE WHEN {electrostatic} THEN {S.IMPEDANCE_MAX_ELECTROSTATIC} ELSE {S.IMPEDANCE_MAX} END"),
        ("sensitivity", str(S.SENSITIVITY_MAX)),
    ):
        v, sanity = f"_{f}", "Spec Sanity"
        rules += [
            (sanity, "spec-nan", "error", f"{v} IS NULL", says(f"{f} is not a number"), [(f, "'0'")]),
            (sanity, "spec-negative", "error", f"{v} < 0", says(f"{f} is negative"), [(f, "'0'")]),
            (sanity, "spec-float", "warning", f"{v} >= 0 AND {v} <> floor({v})", says(f"{f} is not whole"), [(f, f"{v}_up")]),
            (sanity, "spec-range", "warning", f"{v} >= 0 AND {v} = floor({v}) AND {v} > {cap}",
             says(f"{f} is above the usual range"), None),
        ]
    rules += [
        ("Price Tier Tag", None, "warning", "NOT _tiers <=> array(_tier)", says("price tier should be ", "=_tier"),
         [("tags", "_fixed_tags")]),
        ("Price Rounding", "price-negative", "error", "_whole < 0", says("price is negative"), None),
        ("Price Rounding", "price-rounding", "warning", "_whole >= 0 AND _whole % 5 <> 0",
         says("price should be ", "=_rounded"), [("price_usd", "_rounded")]),
        ("Price Rounding", "price-invalid", "error", "_whole IS NULL", says("price is not a number: ", "=price_usd"), None),
        ("Year", None, "error", f"_year <> 0 AND _year NOT BETWEEN {S.YEAR_MIN} AND {last}", says("year out of range: ", "=year"), None),
        ("Missing Field", "brand-missing", "error", "_brand = ''", says("brand is empty"), None),
        ("Missing Field", "model-missing", "error", "_model = ''", says("model is empty"), None),
        (missing, "year-unknown", "warning", "_year = 0", says("year is unknown"), None),
        (missing, "price-unknown", "warning", "_whole = 0", says("price is unknown"), None),
        (missing, "drivers-unknown", "warning", "_kind = '' AND _config = ''", says("drivers are unknown"), None),
        *[
            (missing, f"{f}-unknown", "warning",
             f"_form NOT IN ({quoted((S.TWS, S.WIRELESS_OVER_EAR))}) AND _{f} = 0", says(f"{f} is unknown"), None)
            for f in ("impedance", "sensitivity")
        ],
    ]
    if not enforce_tws:
        rules.append(
            (missing, "tws-nonzero", "warning", f"{tws} AND {loaded}", says("wireless earbuds have no impedance or sensitivity"), None)
        )
    return rules + [
        ("Tag Count", None, "error", f"size(_tags) < {S.TAG_MIN}", says("too few tags: ", "=size(_tags)"), None),
        ("Tag Count", None, "error", f"size(_tags) > {S.TAG_MAX}", says("too many tags: ", "=size(_tags)"), None),
        ("Duplicate Tag", None, "error", "size(_dup_tags) > 0", says("duplicate tags: ", "=array_join(_dup_tags, ', ')"), None),
        ("Unapproved Tag", None, "error", "size(_odd_tags) > 0", says("unapproved tags: ", "=array_join(_odd_tags, ', ')"), None),
        ("Duplicate File", None, "error", "size(array_distinct(_files)) < size(_files)", says("a file is listed twice"), None),
    ]


def _struct(category, code, severity, message, fix, order) -> str:
    return (
        f"named_struct('category', '{category}', 'code', '{code or slug(category)}', 'severity', '{severity}', "
        f"'message', {message}, 'fix', {fix}, 'fix_order', {order})"
    )


def _fix_sql(fix) -> str:
    if not fix:
        return f"cast(NULL AS {FIX_TYPE})"
    writes = []
    for field, value in fix:
        scalar, items = ("NULL", value) if field in S.LIST_FIELDS else (value, "NULL")
        writes.append(
            f"named_struct('field', '{field}', 'pos', cast(NULL AS int), 'value', cast({scalar} AS string), "
            f"'items', cast({items} AS array<string>))"
        )
    return f"array({', '.join(writes)})"


def _element_fix(value: str) -> str:
    return (
        "array(named_struct('field', 'files', 'pos', i, 'value', cast(" + value + " AS string), "
        "'items', cast(NULL AS array<string>)))"
    )


def _row_issues(enforce_tws: bool, last_year: int | None) -> Column:
    """Every rule of a row as one array expression."""
    rules = _rules(enforce_tws, last_year)
    found = [
        f"CASE WHEN {cond} THEN {_struct(category, code, severity, message, _fix_sql(fix), i)} END"
        for i, (category, code, severity, cond, message, fix) in enumerate(rules)
    ]
    n = len(rules)
    conflict = _struct("Tag Conflict", None, "error", says("conflicting tags: ", "=c.pair", "; ", "=c.guidance"), _fix_sql(None), n)
    blank, back = "btrim(f) = ''", "chr(92)"
    path_rules = (
        ("file-empty", "error", f"f IS NULL OR {blank}", says("empty path"), _element_fix("NULL")),
        ("file-ws", "error", f"NOT {blank} AND f <> btrim(f)", says("blanks around path: ", "=f"), _element_fix("btrim(f)")),
        ("file-backslash", "warning", f"NOT {blank} AND contains(f, {back})", says("backslashes in path: ", "=f"),
         _element_fix(f"replace(f, {back}, '/')")),
        ("file-traversal", "error", f"NOT {blank} AND array_contains(split(f, '/'), '..')", says("path leaves the folder: ", "=f"),
         _fix_sql(None)),
    )
    paths = ", ".join(
        f"CASE WHEN {cond} THEN {_struct('File Path', code, severity, message, fix, n + 1 + k)} END"
        for k, (code, severity, cond, message, fix) in enumerate(path_rules)
    )
    return F.expr(
        f"array_compact(concat(array({', '.join(found)}), transform(_clashes, c -> {conflict}), "
        f"flatten(transform(_files, (f, i) -> array({paths})))))"
    )


def shown_id() -> Column:
    return F.when(text("id") != "", F.col("id")).otherwise(
        F.concat(F.lit("(no id) #"), F.col("row_id").cast("string"))
    )


def audit_rows(catalog: DataFrame, enforce_tws: bool = False, last_year: int | None = None) -> DataFrame:
    """Issues that concern one row alone: one scan, one projection, no shuffle."""
    found = with_facts(catalog).select(
        F.col("row_id").cast("bigint").alias("row_id"), shown_id().alias("entry_id"),
        F.explode(_row_issues(enforce_tws, last_year)).alias("i"),
    )
    return found.select(
        "row_id", "entry_id", "i.category", "i.code", "i.severity", F.col("entry_id").alias("subject"),
        "i.message", "i.fix", "i.fix_order",
    )


def _issues(df: DataFrame, category, code, severity, message, row=None, entry=None, subject=None, fix=None, order=-1,
            key_b=None, confidence=None) -> DataFrame:
    null = F.lit(None)
    return df.select(
        (null.cast("bigint") if row is None else row.cast("bigint")).alias("row_id"),
        (F.lit("(summary)") if entry is None else entry).alias("entry_id"),
        F.lit(category).alias("category"),
        F.lit(code or slug(category)).alias("code"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        (F.lit("(summary)") if subject is None else subject).alias("subject"),
        message.alias("message"),
        (no_fix() if fix is None else fix.cast(S.FIX)).alias("fix"),
        F.lit(order).alias("fix_order"),
        (null.cast("bigint") if key_b is None else key_b.cast("bigint")).alias("key_b"),
        (null.cast("string") if confidence is None else confidence).alias("confidence"),
    )


def _words(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def audit_identity(catalog: DataFrame) -> list[DataFrame]:
    """Repeated ids and inconsistent brand spellings."""
    c = F.col
    twins = links.duplicate_ids(catalog.where("id <> ''"), "id", "row_id")
    out = [
        _issues(
            twins, "Duplicate ID", None, "error", _words("id is also used by row ", c("first_row")), c("row_id"),
            c("id"), F.concat_ws("@", "id", "row_id"),
        )
    ]
    fixes = spelling_fixes(catalog, "brand")
    off = catalog.join(fixes, strip("brand") == c("spelling"))
    renamed = build_id("canonical", "model", "variant")
    change = F.array(set_value("brand", c("canonical")), set_value("id", renamed))
    out.append(
        _issues(
            off, "Brand Spelling", "brand-spelling", "warning", _words("brand spellings: ", c("summary")), c("row_id"),
            shown_id(), shown_id(), F.when(c("has_majority"), change), order=1000,
        )
    )
    return out


def audit_links(catalog: DataFrame, files: DataFrame | None) -> list[DataFrame]:
    """Rules about links: shared, misspelled, missing and unused files."""
    c = F.col
    ids = catalog.select("row_id", shown_id().alias("entry_id"), "files")
    linked = links.links(ids.where("files IS NOT NULL")).where("path <> ''")
    out = []

    bare = ids.where("files IS NULL OR size(files) = 0")
    out.append(
        _issues(bare, "No Measurement Files", None, "warning", _words("the entry has no files"), c("row_id"), c("entry_id"), c("entry_id"))
    )
    counted = ids.agg(F.count("*").alias("n_all"), F.count_if(F.expr("files IS NULL OR size(files) = 0")).alias("n")).where("n > 0")
    out.append(
        _issues(
            counted, "No Measurement Files", "no-measurement-files-total", "info", _words(c("n"), " of ", c("n_all"), " entries have no files")
        )
    )

    dims = ids.select("row_id", "entry_id")
    shared = linked.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
    occurrences = linked.join(shared, "path").join(dims, "row_id")
    out.append(
        _issues(
            occurrences, "Duplicate File Link", None, "warning", _words(c("path"), " is linked ", c("n"), " times"),
            c("row_id"), c("entry_id"), F.concat_ws("@", "path", "row_id"),
        )
    )
    spelled = (
        linked.groupBy("fold")
        .agg(F.min("path").alias("p0"), F.max("path").alias("p1"), F.min("row_id").alias("r0"), F.max("row_id").alias("r1"))
        .where("p0 <> p1 AND r0 <> r1")
    )
    mixed = linked.select("fold", "row_id").distinct().join(spelled, "fold").join(dims, "row_id")
    out.append(
        _issues(
            mixed, "Duplicate File Link", "duplicate-file-ci", "warning",
            _words("one file spelled differently: ", c("p0"), ", ", c("p1")), c("row_id"), c("entry_id"),
            F.concat_ws("@", "fold", "row_id"),
        )
    )
    if files is None:
        return out

    recased = links.repair_path_case(catalog, files).join(dims, "row_id")
    recased = recased.groupBy("row_id", "entry_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "new"))).alias("changes")
    )
    fix = F.transform("changes", lambda x: set_element("files", x["pos"], x["new"]))
    out.append(
        _issues(
            recased, "Path Casing", None, "warning", _words("path spelling differs from disk in ", F.size("changes")),
            c("row_id"), c("entry_id"), c("entry_id"), fix, order=500,
        )
    )
    gone = links.missing_files(ids, files).join(dims, "row_id")
    out.append(
        _issues(
            gone, "Missing File", None, "error", _words("file not found: ", c("path")), c("row_id"), c("entry_id"),
            c("entry_id"),
        )
    )
    unused = links.unlinked_report(ids, files)
    out.append(
        _issues(
            unused, "Unlinked File", None, "info",
            F.when(c("path").isNotNull(), _words("file is not linked: ", c("path"))).otherwise(
                _words(c("n"), " files are not linked, the first: ", c("first"))
            ),
            entry=F.lit("(none)"), subject=F.coalesce(c("path"), F.lit("(none)")),
        )
    )
    return out


def audit_duplicates(catalog: DataFrame, method: str = "levenshtein") -> list[DataFrame]:
    """Rows that share a file or look alike, as groups with exact counts and their members, never as all pairs.

    ``dup-link``: one issue per shared file; ``dup-link-row``: one per entry that links it, next to the first one.
    ``dup-name``: one issue per pair of alike names (or name that several rows bear), between the first rows of each;
    ``dup-name-row``: one per further row of such a name, next to the first.
    """
    c = F.col
    specs = ["year", "price_usd", "driver_config"]
    linked = links.links(catalog.where("files IS NOT NULL")).where("path <> ''")
    shared, sharing = links.shared_files(linked)
    block, name = F.lower(strip("brand")), duplicates.dup_name("model", "variant")
    found = duplicates.brand_fuzzy_pairs(catalog, block, name, specs, method=method)
    pairs, bearers = duplicates.name_groups(found, catalog, block, name)
    ids = catalog.select("row_id", shown_id().alias("entry_id"))
    first = ids.select(c("row_id").alias("first_key"), c("entry_id").alias("first_id"))
    what = "Possible Duplicate"
    other = ids.select(c("row_id").alias("key_b"), c("entry_id").alias("id_b"))
    alike = pairs.join(first, c("key_a") == c("first_key")).join(other, "key_b", "left")
    level = F.when(c("n_high") > 0, "high").when(c("kind") == "extends", "low").otherwise("medium")
    rows = sharing.where("key <> first_key").join(ids, c("key") == c("row_id")).join(first, "first_key")
    more = bearers.where("key <> first_key").join(ids, c("key") == c("row_id")).join(first, "first_key")
    return [
        _issues(
            shared, what, "dup-link", "warning", _words(c("n"), " entries link ", c("path"), ", ", c("n_pairs"), " pairs"),
            c("first_key"), subject=F.concat(F.lit("dup|link|"), c("path")), confidence=F.lit("high"),
        ),
        _issues(
            rows, what, "dup-link-row", "warning", _words("links ", c("path"), " as ", c("first_id"), " does"), c("row_id"), c("entry_id"),
            F.concat_ws("|", F.lit("dup"), F.least("entry_id", "first_id"), F.greatest("entry_id", "first_id")),
            key_b=c("first_key"), confidence=F.lit("high"),
        ),
        _issues(
            alike, what, "dup-name", "warning",
            _words(c("n_pairs"), " row pairs named ", c("name_a"), " and ", c("name_b"), " (", c("kind"), ")"), c("key_a"), c("first_id"),
            F.concat_ws("|", F.lit("dup|name"), "block", "name_a", "name_b"), key_b=c("key_b"), confidence=level,
        ),
        _issues(
            more, what, "dup-name-row", "warning", _words("named ", c("name"), " as ", c("first_id"), " is"), c("row_id"), c("entry_id"),
            F.concat_ws("|", F.lit("dup"), F.least("entry_id", "first_id"), F.greatest("entry_id", "first_id")), key_b=c("first_key"),
            confidence=F.lit("medium"),
        ),
    ]


def best_first(issues: DataFrame) -> DataFrame:
    """Duplicate issues by confidence, then by the rows concerned: the order in which pairs are looked at."""
    rank = F.array_position(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), F.col("confidence"))
    return issues.orderBy(rank, F.least("row_id", "key_b"), F.greatest("row_id", "key_b"), "subject")


def audit(
    catalog: DataFrame,
    files: DataFrame | None = None,
    enforce_tws: bool = False,
    last_year: int | None = None,
    method: str = "levenshtein",
    pairs: bool = True,
) -> DataFrame:
    """Every issue of a catalog; file rules need the inventory, pair rules can be left out."""
    null = F.lit(None)
    parts = [
        audit_rows(catalog, enforce_tws, last_year)
        .withColumn("key_b", null.cast("bigint"))
        .withColumn("confidence", null.cast("string"))
        .withColumn("row_id", F.col("row_id").cast("bigint"))
    ]
    parts += audit_identity(catalog) + audit_links(catalog, files)
    if pairs:
        parts += audit_duplicates(catalog, method)
    return reduce(DataFrame.unionByName, [p.select(*ISSUE) for p in parts])
