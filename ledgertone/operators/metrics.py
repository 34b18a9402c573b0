"""Levels, bands, tag votes: one aggregation per curve."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.curves import suggest_tags
from ..functions.numbers import exact_mean

# Bands of the metrics, Hz, and the rules around them.
BASS, MID, PINNA, TREBLE = (20, 100), (500, 1500), (2500, 3500), (6000, 15000)
REF_NARROW, REF_WIDE = (900, 1100), (700, 1300)
MIN_POINTS = 20
MIN_COVERAGE = 0.25
DB_PAD, DB_SPAN = 3.0, 20.0


def within(band, value: str = "spl", freq: str = "freq") -> Column:
    lo, hi = band
    return F.when(F.col(freq).between(lo, hi), F.col(value))


def band_mean(lo, hi) -> Column:
    return exact_mean(within((lo, hi)))


def band_peak(lo, hi) -> Column:
    return F.max(within((lo, hi)))


def _level(fall_back_to_all: bool = False) -> Column:
    """Median near 1 kHz. The median's buffer counts distinct levels, not points."""
    steps = [F.median(within(REF_NARROW)), F.median(within(REF_WIDE))]
    if fall_back_to_all:
        steps.append(F.median("spl"))
    return F.coalesce(*steps)


def ref_level(points: DataFrame, key: str = "curve_id", fall_back_to_all: bool = False) -> DataFrame:
    return points.groupBy(key).agg(_level(fall_back_to_all).alias("ref"), F.count("*").alias("n"))


def band_metrics(points: DataFrame, bands: dict[str, tuple[float, float]], key: str = "curve_id") -> DataFrame:
    """Mean and peak of every band in one aggregation."""
    aggs = []
    for name, (lo, hi) in bands.items():
        aggs += [band_mean(lo, hi).alias(f"{name}_mean"), band_peak(lo, hi).alias(f"{name}_peak")]
    return points.groupBy(key).agg(*aggs)


def curve_metrics(points: DataFrame, keys=("curve_id",)) -> DataFrame:
    """ok, error and the metrics relative to 1 kHz, rounded half-even to one decimal.

    The treble band ends at the curve's last frequency, which no point exceeds, so its upper
    bound needs no second pass.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    base = points.groupBy(*keys).agg(
        F.count("*").alias("n_points"),
        F.min("freq").alias("fmin"),
        F.max("freq").alias("fmax"),
        _level().alias("ref"),
        band_mean(*BASS).alias("b"),
        band_mean(*MID).alias("m"),
        band_mean(*PINNA).alias("p"),
        band_peak(*PINNA).alias("pp"),
        band_mean(*TREBLE).alias("t"),
        band_peak(*TREBLE).alias("tp"),
    )
    cover = (F.least(F.lit(float(TREBLE[1])), F.col("fmax").cast("double")) - TREBLE[0]) / float(TREBLE[1] - TREBLE[0])
    error = F.when(F.col("n_points") < MIN_POINTS, F.lit("too few points")).when(
        F.col("ref").isNull(), F.lit("no level near 1 kHz")
    )
    base = base.withColumn("error", error).withColumn("treble_coverage", cover)

    def rel(c, cond=None):
        value = F.bround(F.col(c).cast("double") - F.col("ref").cast("double"), 1)
        ok = F.col("error").isNull()
        return F.when(ok if cond is None else ok & cond, value)

    full = F.col("treble_coverage") >= MIN_COVERAGE
    return base.select(
        *keys, "error", "n_points", "ref", "treble_coverage",
        F.format_string("%.0fHz - %.0fHz", F.col("fmin").cast("double"), F.col("fmax").cast("double")).alias("coverage"),
        rel("b").alias("bass_shelf"),
        rel("m").alias("mid_level"),
        rel("p").alias("pinna_gain"),
        rel("pp").alias("pinna_peak"),
        rel("t", full).alias("treble_avg"),
        rel("tp", full).alias("treble_peak"),
        rel("t", ~full).alias("treble_avg_partial"),
        rel("tp", ~full).alias("treble_peak_partial"),
    )


METRICS = ("bass_shelf", "mid_level", "pinna_gain", "pinna_peak", "treble_avg", "treble_peak")


def curve_tags(metrics: DataFrame) -> DataFrame:
    """The metrics with ``tags``: suggestions in order, null where a curve has an error."""
    return metrics.withColumn(
        "tags", F.when(F.col("error").isNull(), suggest_tags(F.struct(*METRICS)))
    )


def vote_tags(tagged: DataFrame, entry: str) -> DataFrame:
    """entry, tag, votes, best_rank, n_files, position: tags more than half of the curves suggest."""
    files = tagged.groupBy(entry).agg(
        F.count_if(F.col("error").isNull()).alias("n_files"), F.count_if(F.col("error").isNotNull()).alias("n_unreadable")
    )
    votes = (
        tagged.where("error IS NULL")
        .select(entry, F.posexplode("tags").alias("rank", "t"))
        .where(F.col("t.tag").isin(*S.APPROVED_TAGS))
        .groupBy(entry, F.col("t.tag").alias("tag"))
        .agg(F.count("*").alias("votes"), F.min("rank").alias("best_rank"))
    )
    won = votes.join(files, entry).where("votes >= n_files div 2 + 1")
    # at most one row per approved tag and entry is left, so this window is small
    w = Window.partitionBy(entry).orderBy(F.desc("votes"), "best_rank", "tag")
    return won.withColumn("position", F.row_number().over(w))


def mean_metrics(tagged: DataFrame, entry: str) -> DataFrame:
    """Mean of each metric over an entry's readable curves, one decimal."""
    return tagged.where("error IS NULL").groupBy(entry).agg(
        F.count("*").alias("n_files"), *[F.bround(exact_mean(m), 1).alias(m) for m in METRICS]
    )


def axis_bounds(points: DataFrame, keys=()) -> DataFrame:
    """lo, hi of a plot's level axis: padded, at least 20 dB, in steps of 5, within -60..40."""
    ends = points.groupBy(*keys).agg(F.min("spl").cast("double").alias("d0"), F.max("spl").cast("double").alias("d1"))
    lo, hi = F.col("d0") - DB_PAD, F.col("d1") + DB_PAD
    mid, narrow = (lo + hi) / 2, hi - lo < DB_SPAN
    lo, hi = F.when(narrow, mid - DB_SPAN / 2).otherwise(lo), F.when(narrow, mid + DB_SPAN / 2).otherwise(hi)
    return ends.select(
        *keys,
        F.greatest(F.lit(-60.0), F.floor(lo / 5) * 5.0).alias("lo"),
        F.least(F.lit(40.0), F.ceil(hi / 5) * 5.0).alias("hi"),
    )
