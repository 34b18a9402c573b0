"""Driver configuration text such as ``1DD+2BA``."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S
from .text import SPACE_CLASS, text

TOKEN = r"^(\d+)([A-Za-z]+)$"


def _tokens(c) -> Column:
    return F.filter(F.split(F.replace(text(c), F.lit(" "), F.lit("")), r"\+"), lambda t: t != "")


def _count(token) -> Column:
    return F.regexp_extract(token, TOKEN, 1).try_cast("bigint")


def _known(token) -> Column:
    tech = F.upper(F.regexp_extract(token, TOKEN, 2))
    return tech.isin([t.upper() for t in S.DRIVER_TECHS]) & F.coalesce(_count(token) > 0, F.lit(False))


def driver_parts(c) -> Column:
    """``array<struct<tech,n>>`` in canonical order; the last count of a technology wins."""
    good = F.filter(_tokens(c), _known)

    def latest(tech):
        same = F.filter(good, lambda t: F.upper(F.regexp_extract(t, TOKEN, 2)) == F.upper(tech))
        return F.struct(tech.alias("tech"), _count(F.try_element_at(same, F.lit(-1))).alias("n"))

    techs = F.array(*[F.lit(t) for t in S.DRIVER_TECHS])
    return F.filter(F.transform(techs, latest), lambda p: p["n"].isNotNull())


def parse_driver(c) -> Column:
    return F.map_from_entries(driver_parts(c))


def classify_driver(parts) -> Column:
    """``struct<type,config>`` of the parts; both blank when there are none."""
    n = F.size(parts)
    kind = (
        F.when(n == 0, F.lit(""))
        .when(n == 1, F.try_element_at(parts, F.lit(1))["tech"])
        .when(n == 2, F.lit("Hybrid"))
        .otherwise(F.lit("Tribrid"))
    )
    config = F.array_join(F.transform(parts, lambda p: F.concat(p["n"].cast("string"), p["tech"])), "+")
    return F.struct(kind.alias("type"), config.alias("config"))


def unknown_driver_tokens(c) -> Column:
    return F.filter(_tokens(c), lambda t: ~_known(t))


def despaced(c) -> Column:
    return F.regexp_replace(text(c), f"[{SPACE_CLASS}]+", "")
