"""Values the audit and the validation gate derive from a row, each computed once."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.drivers import classify_driver, despaced, driver_parts, unknown_driver_tokens
from ..functions.numbers import coerce_int, finite, half_up, price_tier, py_float, round_to_5, tier_basis
from ..functions.tags import duplicated, fix_tier_tags, tag_conflicts, tag_list
from ..functions.text import build_id, normalize_component, strip, text
from ..session import spread


def number(df: DataFrame, name: str) -> Column:
    """A numeric reading of a column whether it is typed or still raw text."""
    return py_float(name) if dict(df.dtypes)[name] == "string" else F.col(name).cast("double")


def whole(df: DataFrame, name: str, default: int | None) -> Column:
    """``coerce_int`` of a column; whole numbers need no reading."""
    if dict(df.dtypes)[name] in ("tinyint", "smallint", "int"):
        return F.coalesce(F.col(name), F.lit(default)).cast("bigint")
    return coerce_int(name, default)


def with_facts(df: DataFrame) -> DataFrame:
    """The input with one ``_column`` per derived value."""
    df = spread(df)
    df = df.select(
        *df.columns,
        strip("brand").alias("_brand"),
        strip("model").alias("_model"),
        strip("variant").alias("_variant"),
        strip("driver_type").alias("_kind"),
        strip("driver_config").alias("_config"),
        text("driver_config").rlike(r"\s").alias("_blanks"),
        despaced("driver_config").alias("_tight"),
        strip("form_factor").alias("_form"),
        strip("connector").alias("_conn"),
        whole(df, "year", -1).alias("_year"),
        finite(number(df, "price_usd")).alias("_price"),
        whole(df, "price_usd", None).alias("_whole"),
        finite(number(df, "impedance")).alias("_impedance"),
        finite(number(df, "sensitivity")).alias("_sensitivity"),
        tag_list("tags").alias("_tags"),
        tag_list("files").alias("_files"),
    )
    df = df.select(
        *df.columns,
        build_id("_brand", "_model", "_variant").alias("_want"),
        F.array_compact(
            F.array(
                *[
                    F.when((F.col(f"_{f}") != "") & (normalize_component(f"_{f}") == ""), F.lit(f))
                    for f in ("brand", "model", "variant")
                ]
            )
        ).alias("_nonlatin"),
        driver_parts("_config").alias("_parts"),
        unknown_driver_tokens("_config").alias("_strange"),
        price_tier(tier_basis("_price")).alias("_tier"),
        round_to_5("_whole").alias("_rounded"),
        F.filter("_tags", lambda t: t.isin(*S.TAGS_TIER)).alias("_tiers"),
        fix_tier_tags("_tags", F.col("_price")).alias("_fixed_tags"),
        duplicated("_tags").alias("_dup_tags"),
        F.array_except("_tags", F.array(*[F.lit(t) for t in S.APPROVED_TAGS])).alias("_odd_tags"),
        tag_conflicts("_tags").alias("_clashes"),
        half_up("_impedance").alias("_impedance_up"),
        half_up("_sensitivity").alias("_sensitivity_up"),
    )
    return df.withColumn("_driver", classify_driver(F.col("_parts")))


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


# forms that take only some connectors
BAD_CONNECTOR = (
    f"_conn IN ({quoted(S.CONNECTORS)}) AND CASE _form "
    + " ".join(f"WHEN '{form}' THEN _conn NOT IN ({quoted(ok)})" for form, ok in S.FORM_CONNECTORS.items())
    + " ELSE false END"
)


def says(*parts) -> str:
    """SQL for a message: plain text and, marked by a leading =, expressions."""
    return "concat(" + ", ".join(
        f"coalesce(cast({p[1:]} AS string), '')" if p.startswith("=") else f"'{p}'" for p in parts
    ) + ")"
