"""Curves point by point: interpolation, smoothing, averaging, thinning.

Points are (curve_id, freq, spl). Windows never run over a whole curve: they run over slices
of its axis, with the neighbouring samples carried across slice borders, so a curve that
holds a large share of all points is still worked on by many tasks.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.curves import F_MAX, F_MIN, log_fraction
from ..functions.numbers import exact_mean

SLICES_PER_OCTAVE = 4
#: Slices per octave in which sums run; a place where millions of points crowd still spreads over many.
SUMMED_PER_OCTAVE = 512


def octave_slice(freq: str = "freq", per_octave: int = SLICES_PER_OCTAVE) -> Column:
    f = F.greatest(F.col(freq).cast("double"), F.lit(1e-6))
    return F.floor(F.log2(f) * per_octave)


def interpolate(points: DataFrame, grid: DataFrame, keys=("curve_id",), slice_of: str | None = None,
                keep: tuple[str, ...] = ()) -> DataFrame:
    """Linear values of each curve at the grid's frequencies, clamped at the curve's ends.

    ``grid`` has the keys, ``freq`` and the columns named in ``keep``. ``slice_of`` is the SQL
    that cuts the axis, quarter octaves by default. Samples and grid are
    united and sorted once per (curve, slice); the nearest samples beyond a slice come from
    an aggregate with one row per slice.
    """
    keys = list(keys)
    slice_of = octave_slice() if slice_of is None else F.expr(slice_of)
    samples = points.select(
        *keys, "freq", "spl", F.lit(True).alias("_s"), *[F.lit(None).cast(grid.schema[k].dataType).alias(k) for k in keep]
    )
    wanted = grid.select(*keys, "freq", F.lit(None).cast(points.schema["spl"].dataType).alias("spl"), F.lit(False).alias("_s"), *keep)
    both = samples.unionByName(wanted).withColumn("_slice", slice_of)

    sample = F.when(F.col("_s"), F.struct("freq", "spl"))
    cells = both.groupBy(*keys, "_slice").agg(F.min(sample).alias("lo"), F.max(sample).alias("hi"))
    across = Window.partitionBy(*keys).orderBy("_slice")
    cells = cells.select(
        *keys, "_slice",
        F.last("hi", True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("lo", True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    within = Window.partitionBy(*keys, "_slice").orderBy("freq", F.col("_s").desc())
    placed = both.join(cells, [*keys, "_slice"]).select(
        *keys, "freq", "_s", *keep,
        F.coalesce(F.last(sample, True).over(within.rowsBetween(Window.unboundedPreceding, 0)), "_before").alias("l"),
        F.coalesce(F.first(sample, True).over(within.rowsBetween(0, Window.unboundedFollowing)), "_after").alias("r"),
    )
    l_, r_ = F.col("l"), F.col("r")
    t = (F.col("freq") - l_["freq"]) / F.nullif(r_["freq"] - l_["freq"], F.lit(0.0))
    value = (
        F.when(l_.isNull(), r_["spl"].cast("double"))
        .when(r_.isNull() | (l_["freq"] == F.col("freq")), l_["spl"].cast("double"))
        .otherwise(l_["spl"].cast("double") + t * (r_["spl"].cast("double") - l_["spl"].cast("double")))
    )
    return placed.where("NOT _s").select(*keys, "freq", *keep, value.alias("spl"))


def overlap_bounds(points: DataFrame, group: str, curve: str = "curve_id") -> DataFrame:
    """lo, hi: the band every curve of a group covers (lo > hi when there is none)."""
    ends = points.groupBy(group, curve).agg(F.min("freq").alias("f0"), F.max("freq").alias("f1"))
    return ends.groupBy(group).agg(
        F.max("f0").alias("lo"), F.min("f1").alias("hi"), F.min(curve).alias("first_curve"), F.count("*").alias("n_curves")
    )


def pair_bounds(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    ends_a = a.groupBy(key).agg(F.min("freq").alias("a0"), F.max("freq").alias("a1"))
    ends_b = b.groupBy(key).agg(F.min("freq").alias("b0"), F.max("freq").alias("b1"))
    return ends_a.join(ends_b, key).select(
        key, F.greatest("a0", "b0").alias("lo"), F.least("a1", "b1").alias("hi")
    )


def b_on_a(a: DataFrame, b: DataFrame, key: str, slice_of: str | None) -> DataFrame:
    """key, freq, spl_a, spl_b on A's points inside the common band."""
    band = pair_bounds(a, b, key)
    grid = a.join(band, key).where("freq >= lo AND freq <= hi").select(key, "freq", F.col("spl").alias("spl_a"))
    return interpolate(b, grid, (key,), slice_of, keep=("spl_a",)).withColumnRenamed("spl", "spl_b")


def mean_of(onto: DataFrame, key: str) -> DataFrame:
    return onto.select(key, "freq", ((F.col("spl_a").cast("double") + F.col("spl_b")) / 2).alias("spl"))


def mismatch_of(band: DataFrame, onto: DataFrame, key: str) -> DataFrame:
    gap = onto.groupBy(key).agg(exact_mean(F.abs(F.col("spl_a").cast("double") - F.col("spl_b"))).alias("m"))
    return band.join(gap, key, "left").select(
        key, F.when(F.col("lo") > F.col("hi"), float("inf")).otherwise(F.coalesce("m", F.lit(0.0))).alias("mismatch")
    )


def average_pair(a: DataFrame, b: DataFrame, key: str = "curve_id", slice_of: str | None = None) -> DataFrame:
    """Mean of two curves per key on A's grid over the common band."""
    return mean_of(b_on_a(a, b, key, slice_of), key)


def curve_diff(a: DataFrame, b: DataFrame, key: str = "curve_id", slice_of: str | None = None) -> DataFrame:
    """A minus B on A's grid over the common band, levels as they are."""
    return b_on_a(a, b, key, slice_of).select(key, "freq", (F.col("spl_a").cast("double") - F.col("spl_b")).alias("diff"))


def diff_summary(diff: DataFrame, key: str = "curve_id") -> DataFrame:
    return diff.groupBy(key).agg(F.max("diff").alias("max_diff"), exact_mean("diff").alias("mean_diff"), F.count("*").alias("n"))


def pair_mismatch(a: DataFrame, b: DataFrame, key: str = "curve_id", slice_of: str | None = None) -> DataFrame:
    """Mean absolute difference per key: infinite when disjoint, 0 without a common point."""
    return mismatch_of(pair_bounds(a, b, key), b_on_a(a, b, key, slice_of), key)


def consensus_curve(points: DataFrame, entry: str, curve: str = "curve_id", salts: int = 16) -> DataFrame:
    """Mean of an entry's curves on its first curve's grid, over the band all of them cover.

    The grid is copied per salt and the curves are spread over the salts, so an entry with
    very many curves is not joined in one task; the mean itself is partially aggregated.
    """
    band = overlap_bounds(points, entry, curve)
    grid = (
        points.join(band, entry)
        .where((F.col(curve) == F.col("first_curve")) & F.col("freq").between(F.col("lo"), F.col("hi")))
        .select(entry, "freq", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    )
    members = points.select(entry, curve).distinct().withColumn("_salt", F.pmod(F.hash(curve), F.lit(salts)))
    wanted = members.join(grid, [entry, "_salt"]).select(entry, curve, "freq")
    each = interpolate(points.select(entry, curve, "freq", "spl"), wanted, (entry, curve))
    return each.groupBy(entry, "freq").agg(exact_mean("spl").alias("spl"), F.count("*").alias("n_curves"))


def normalize_curve(points: DataFrame, curve: str = "curve_id") -> DataFrame:
    """20 Hz to 20 kHz with the 1 kHz level at zero."""
    from .metrics import ref_level

    clipped = points.where(F.col("freq").between(F_MIN, F_MAX))
    ref = ref_level(clipped, curve, fall_back_to_all=True).select(curve, "ref")
    out = [F.col(c) if c != "spl" else (F.col("spl") - F.col("ref")).alias("spl") for c in points.columns]
    return clipped.join(ref, curve).select(*out)


def smooth_octaves(points: DataFrame, frac: float = 1 / 12, keys=("curve_id",)) -> DataFrame:
    """Mean level within half of ``frac`` octaves to either side; short curves stay as they are.

    A window's sum is the difference of two running sums: every place of a curve is one value and asks for the sums up
    to its two borders, which lie in slices of their own. Sums run within a slice, the totals of earlier slices (one row
    each) are added; so work and memory don't grow with the window. Levels count exactly, to six decimals; null levels
    and points without a place on the axis are left out.
    """
    keys, half = list(keys), frac / 2
    placed = points.withColumn("_lf", F.log2(F.col("freq").cast("double")))
    level = F.sum(F.col("spl").cast("decimal(18,6)"))
    places = placed.where("_lf IS NOT NULL").groupBy(*keys, "_lf").agg(F.coalesce(level, F.lit(0)).cast("decimal(28,6)").alias("_s"), F.count("spl").alias("_c"))

    def mark(at, kind, s, c):
        return F.struct(at.alias("_at"), F.lit(kind).alias("_kind"), s.cast("decimal(28,6)").alias("_s"), c.cast("bigint").alias("_c"))

    # at one place the lower border comes before the value and the upper one after it
    lf, none = F.col("_lf"), F.lit(0)
    marks = F.array(mark(lf - half, 0, none, none), mark(lf, 1, F.col("_s"), F.col("_c")), mark(lf + half, 2, none, none))
    marks = places.select(*keys, "_lf", F.explode(marks).alias("m")).select(*keys, "_lf", "m.*")
    marks = marks.withColumn("_slice", F.floor(F.col("_at") * SUMMED_PER_OCTAVE))
    within = Window.partitionBy(*keys, "_slice").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = marks.groupBy(*keys, "_slice").agg(F.sum("_s").alias("_s"), F.sum("_c").alias("_c"))
    totals = totals.select(*keys, "_slice", *[F.coalesce(F.sum(c).over(before), none).alias(f"{c}0") for c in ("_s", "_c")])
    sums = marks.withColumn("_s", F.sum("_s").over(within)).withColumn("_c", F.sum("_c").over(within)).where("_kind <> 1")
    sums = sums.join(totals, [*keys, "_slice"]).select(
        *keys, "_lf", *[F.when(F.col("_kind") == 2, total).otherwise(-total).alias(c) for c, total in
          (("_s", (F.col("_s") + F.col("_s0")).cast("decimal(28,6)")), ("_c", F.col("_c") + F.col("_c0")))],
    )
    means = sums.groupBy(*keys, "_lf").agg((F.sum("_s").cast("double") / F.nullif(F.sum("_c"), none)).alias("_mean"))
    counts = points.groupBy(*keys).agg(F.count("*").alias("_n"))
    kept = F.when(F.col("_n") < 5, F.col("spl").cast("double")).otherwise(F.col("_mean"))
    return placed.join(means, [*keys, "_lf"]).join(counts, keys).select(
        *[kept.alias("spl") if c == "spl" else F.col(c) for c in points.columns]
    )


def _positions(points: DataFrame, keys: list[str]) -> DataFrame:
    """Zero-based position ``_i`` and size ``_n`` of every point in its curve, by slices."""
    sliced = points.withColumn("_slice", octave_slice())
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys).orderBy("_slice")
    sizes = sizes.select(
        *keys, "_slice",
        F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"),
    )
    within = Window.partitionBy(*keys, "_slice").orderBy("freq")
    return sliced.join(sizes, [*keys, "_slice"]).withColumn("_i", F.col("_before") + F.row_number().over(within) - 1)


def stride_downsample(points: DataFrame, n: int = 20000, keys=("curve_id",)) -> DataFrame:
    """At most ``n`` points per curve: those at floor(i * size / n)."""
    placed = _positions(points, list(keys))
    # position p is taken when some i < n has floor(i * size / n) = p
    size, p = F.col("_n").cast("double"), F.col("_i")
    i = F.ceil(p * n / size)
    taken = (size <= n) | ((i < n) & (F.floor(i * (size / n)) == p))
    return placed.where(taken).select(*points.columns)


def envelope_downsample(points: DataFrame, buckets: int = 1000, keys=("curve_id",), place: Column | None = None) -> DataFrame:
    """Lowest and highest level per bucket of the log axis, so narrow peaks survive."""
    place = log_fraction("freq") if place is None else place
    return points.groupBy(*keys, F.floor(place * buckets).cast("bigint").alias("bucket")).agg(
        F.min("spl").alias("lo"), F.max("spl").alias("hi"), F.count("*").alias("n")
    )


def curves_for_entry(catalog: DataFrame, points: DataFrame, key: str = "row_id") -> DataFrame:
    """key, n_files, n_used: linked files and how many of them have points."""
    from .links import links

    linked = links(catalog, key).select(key, F.col("path").alias("curve_id"))
    present = points.select("curve_id").distinct().withColumn("_has", F.lit(1))
    return linked.join(present, "curve_id", "left").groupBy(key).agg(
        F.count("*").alias("n_files"), F.count("_has").alias("n_used")
    )


def entry_points(catalog: DataFrame, points: DataFrame, key: str = "row_id") -> DataFrame:
    """The points of every linked file with the entry that links it."""
    from .links import links

    linked = links(catalog, key).select(key, F.col("path").alias("curve_id")).distinct()
    return linked.join(points, "curve_id")
