"""One-line description of a change."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S


def _shown(c: Column, before: str, after: str = "") -> Column:
    return F.concat(F.lit(before), F.coalesce(c.cast("string"), F.lit("None")), F.lit(after))


def _number(c: Column) -> Column:
    return _shown(c, "")


def _money(c: Column) -> Column:
    return _shown(c, "$")


def _quoted(c: Column) -> Column:
    return _shown(c, "'", "'")


def _length(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0)).cast("string")


#: (field, label, how a value is shown, what follows), in the order fields are named
FORMATS = tuple(
    (f, "Price", _money, "") if f == "price_usd"
    else (f, f.capitalize(), _length, " item(s)") if f in S.LIST_FIELDS
    else (f, f.capitalize(), _number if f in S.INT_FIELDS else _quoted, "")
    for f in S.FIELDS
    if f != "id"
)


def describe_change(before, after, max_fields: int = 3) -> Column:
    """First changed fields of two entry structs, lists as counts, ``(+n more)`` at the end."""
    before, after = (F.col(x) if isinstance(x, str) else x for x in (before, after))
    differing = [
        F.when(
            ~before[f].eqNullSafe(after[f]),
            F.concat(F.lit(f"{label}: "), show(before[f]), F.lit(" -> "), show(after[f]), F.lit(end)),
        )
        for f, label, show, end in FORMATS
    ]
    lines = F.array_compact(F.array(*differing))
    named = F.array_join(F.slice(lines, 1, max_fields), "; ")
    rest = F.size(lines) - max_fields
    told = F.when(rest > 0, F.concat(named, F.lit("; (+"), rest.cast("string"), F.lit(" more)"))).otherwise(named)
    missing = F.when(before.isNull() & after.isNull(), "").when(before.isNull(), "created").when(after.isNull(), "removed")
    return F.coalesce(missing, told)
