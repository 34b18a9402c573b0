"""The catalog's field-filter search as one boolean column."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import num_expr
from .text import col

COLUMNS = {
    name: name
    for name in (
        "id", "brand", "model", "variant", "year", "price_usd",
        "driver_type", "driver_config", "connector", "form_factor", "tags",
    )
}

#: matcher -> the fields it reads -> the names a query may use for them
ALIASES = {
    "words": {
        "id": "id", "brand": "brand", "model": "model", "variant": "variant", "connector": "conn connector",
        "form_factor": "ff form form_factor", "driver_type driver_config": "driver drv",
    },
    "items": {"tags": "tag tags"},
    "amount": {"price_usd": "price", "year": "year"},
}
FILTERS = {
    alias: (matcher, fields.split())
    for matcher, named in ALIASES.items()
    for fields, aliases in named.items()
    for alias in aliases.split()
}


def _words(columns: list[Column], value: str) -> Column:
    return F.concat_ws(" ", *[F.lower(F.coalesce(c.cast("string"), F.lit(""))) for c in columns]).contains(value)


def _items(columns: list[Column], value: str) -> Column:
    return F.coalesce(F.exists(columns[0], lambda t: F.lower(t).contains(value)), F.lit(False))


def _amount(columns: list[Column], value: str) -> Column:
    return num_expr(F.coalesce(columns[0], F.lit(0)), value)


MATCHERS = {"words": _words, "items": _items, "amount": _amount}
ANYWHERE = ("words", ["brand", "model", "variant", "id"])


def search(query: str, columns: dict[str, str] | None = None) -> Column:
    """All whitespace-separated terms must match; ``field:value`` aims at one field.

    A term whose field is unknown is looked for as it stands. ``columns`` maps catalog fields to the names a table uses.
    """
    names = {**COLUMNS, **(columns or {})}
    out = F.lit(True)
    for term in query.lower().split():
        key, colon, value = term.partition(":")
        (matcher, fields), wanted = (FILTERS[key], value) if colon and key in FILTERS else (ANYWHERE, term)
        out = out & MATCHERS[matcher]([col(names[f]) for f in fields], wanted)
    return out
