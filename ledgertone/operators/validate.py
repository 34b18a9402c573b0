"""The gate every written entry must pass: an ordered list of errors per row."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.numbers import year_max
from .facts import BAD_CONNECTOR, quoted, says, with_facts


def _checks(raw_text: set[str], last: int) -> list[tuple[str, str]]:
    """(condition, message) in the order callers report them; only the row itself is needed."""
    whole = "_price"
    price = [("_price IS NULL", says("price is not a finite number"))]
    if "price_usd" in raw_text:
        is_whole = "trim(price_usd) RLIKE '^[+-]?[0-9]+$'"
        price = [(f"NOT coalesce({is_whole}, false)", says("price is not a whole number: ", "=price_usd"))]
        whole = f"CASE WHEN {is_whole} THEN _price END"
    specs = []
    for f in ("impedance", "sensitivity"):
        if f in raw_text:
            specs.append((f"contains({f}, '.')", says(f"{f} is not a whole number")))
        specs += [(f"_{f} IS NULL", says(f"{f} is not a finite number")), (f"_{f} < 0", says(f"{f} is negative"))]
    return [
        ("_brand = ''", says("brand is required")),
        ("_model = ''", says("model is required")),
        ("_want = ''", says("no id can be built")),
        ("_want <> '' AND NOT id <=> _want", says("id should be ", "=_want")),
        (f"_year <> 0 AND _year NOT BETWEEN {S.YEAR_MIN} AND {last}", says("year out of range: ", "=year")),
        *price,
        (f"{whole} < 0", says("price is negative")),
        (f"{whole} > {S.PRICE_MAX}", says("price is above the maximum")),
        (f"{whole} BETWEEN 0 AND {S.PRICE_MAX} AND {whole} % 5 <> 0", says("price is not a multiple of 5: ", "=_whole")),
        ("_form = ''", says("form factor is required")),
        (f"_form <> '' AND _form NOT IN ({quoted(S.FORM_FACTORS)})", says("unknown form factor: ", "=_form")),
        ("_conn = ''", says("connector is required")),
        (f"_conn <> '' AND _conn NOT IN ({quoted(S.CONNECTORS)})", says("unknown connector: ", "=_conn")),
        (BAD_CONNECTOR, says("connector ", "=_conn", " does not fit ", "=_form")),
        (f"_kind NOT IN ({quoted(S.DRIVER_TYPES)})", says("unknown driver type: ", "=_kind")),
        ("_blanks", says("driver config has blanks")),
        ("_kind <> '' AND _config = ''", says("driver type without config")),
        ("_config <> '' AND _kind = '' AND size(_parts) > 0", says("driver config without type")),
        ("size(_strange) > 0", says("unknown driver tokens: ", "=array_join(_strange, ', ')")),
        ("size(_parts) > 0 AND _driver.type <> _kind", says("driver type should be ", "=_driver.type")),
        *specs,
        ("size(_dup_tags) > 0", says("duplicate tags: ", "=array_join(_dup_tags, ', ')")),
        ("size(_odd_tags) > 0", says("unapproved tags: ", "=array_join(_odd_tags, ', ')")),
        (f"size(_tags) < {S.TAG_MIN}", says(f"fewer than {S.TAG_MIN} tags")),
        (f"size(_tags) > {S.TAG_MAX}", says(f"more than {S.TAG_MAX} tags")),
    ]


def with_row_errors(df: DataFrame, last_year: int | None = None, name: str = "errors") -> DataFrame:
    """The input with the errors that need no other row."""
    raw_text = {n for n, t in df.dtypes if t == "string"}
    listed = ", ".join(f"CASE WHEN {c} THEN {m} END" for c, m in _checks(raw_text, last_year or year_max()))
    clashes = f"transform(_clashes, c -> {says('conflicting tags: ', '=c.pair')})"
    tier = (
        f"CASE WHEN size(_tiers) <> 1 THEN {says('exactly one price tier tag is required')} "
        f"WHEN _tiers[0] <> _tier THEN {says('price tier should be ', '=_tier')} END"
    )
    errors = F.expr(f"array_compact(concat(array({listed}), {clashes}, array({tier})))")
    return with_facts(df).select(*df.columns, errors.alias(name))


def validate(df: DataFrame, key: str = "row_id", last_year: int | None = None) -> DataFrame:
    """The input with ``errors``; ids must also be unique across rows."""
    shared = df.where("id <> ''").groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1")
    checked = with_row_errors(df, last_year, "_errors").join(shared, "id", "left")
    taken = F.when(F.col("_n").isNotNull(), F.array(F.concat(F.lit("id is used by another entry: "), F.col("id"))))
    errors = F.concat("_errors", F.coalesce(taken, F.array().cast("array<string>")))
    return checked.withColumn("errors", errors).select(*df.columns, "errors")
