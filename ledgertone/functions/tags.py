"""Tag conflicts and price-tier repair."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S
from .numbers import price_tier, tier_basis
from .text import col


def literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def tag_list(tags) -> Column:
    return F.coalesce(col(tags), F.array().cast("array<string>"))


def tag_conflicts(tags) -> Column:
    """``array<struct<pair,guidance>>``: the listed pairs, then several primary profiles."""
    tags = tag_list(tags)

    def finding(pair, guidance):
        return F.struct(pair.alias("pair"), F.lit(guidance).alias("guidance"))

    def settled(drop):
        return f"drop {drop}" if drop else "drop the one that the curves support less"

    listed = [
        F.when(F.array_contains(tags, a) & F.array_contains(tags, b), finding(F.lit(f"{a} + {b}"), settled(drop)))
        for a, b, drop in S.TAG_CONFLICTS
    ]
    primary = F.array_intersect(literals(S.PRIMARY_TONALITY), tags)
    joined = F.array_join(primary, " + ")
    fresh = (F.size(primary) > 1) & ~joined.isin([f"{a} + {b}" for a, b, _ in S.TAG_CONFLICTS])
    return F.array_compact(F.array(*listed, F.when(fresh, finding(joined, "keep one primary profile"))))


def expected_tier(price) -> Column:
    return price_tier(tier_basis(price))


def tier_tags(tags) -> Column:
    return F.filter(tag_list(tags), lambda t: t.isin(*S.TAGS_TIER))


def fix_tier_tags(tags, price) -> Column:
    """The expected tier in the place of the first tier tag, others dropped, else appended."""
    tags, tier = tag_list(tags), expected_tier(price)
    place = F.array_position(F.transform(tags, lambda t: t.isin(*S.TAGS_TIER)), True)
    kept = F.filter(
        F.transform(
            tags,
            lambda t, i: F.when(~t.isin(*S.TAGS_TIER), t).when(i + 1 == place, tier),
        ),
        lambda t: t.isNotNull(),
    )
    return F.when(place > 0, kept).otherwise(F.array_append(tags, tier))


def duplicated(items) -> Column:
    """Values that occur more than once, sorted."""
    items = tag_list(items)
    return F.array_sort(
        F.filter(F.array_distinct(items), lambda x: F.size(F.filter(items, lambda y: y == x)) > 1)
    )
