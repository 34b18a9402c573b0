"""Curve analytics: embeddings as regular curves by label, events as irregular curves by user."""

from pyspark.sql import functions as F

from ..operators import convert as V
from ..operators import metrics as M
from ..operators import points as P
from ..sources.curve_files import lenient_points_from_lines, points_from_lines, queue_paths
from .base import query, table

STEP = 63.0
POINTS = """pts AS (SELECT vec_id AS curve_id, label, pos, 20 * pow(1000, pos / 63.0) AS freq, spl FROM (
  SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS pos, CAST(CAST(unnest(embedding) AS DOUBLE) * 40 AS DECIMAL(18, 6)) AS spl FROM embeddings))"""


def curves(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "e"))
    return e.select(
        F.col("vec_id").alias("curve_id"), "label", "pos",
        (20 * F.pow(F.lit(1000.0), F.col("pos") / STEP)).alias("freq"),
        (F.col("e").cast("double") * 40).cast("decimal(18,6)").alias("spl"),
    )


def position(freq="freq"):
    """The grid position of a frequency; powers differ in the last bit between engines."""
    return F.round(F.log(F.col(freq) / 20) / F.log(F.lit(1000.0)) * STEP).cast("bigint")


def mean(cond: str, c: str = "spl") -> str:
    return f"CAST(sum({c}) FILTER ({cond}) AS DOUBLE) / count({c}) FILTER ({cond})"


REF = """coalesce(median(CAST(spl AS DOUBLE)) FILTER (freq BETWEEN 900 AND 1100), median(CAST(spl AS DOUBLE)) FILTER (freq BETWEEN 700 AND 1300))"""


@query("ref_level", f"WITH {POINTS} SELECT curve_id, {REF} AS ref, count(*) AS n FROM pts GROUP BY 1")
def ref_level(spark, sf):
    return M.ref_level(curves(spark, sf))


@query("band_metrics", f"""WITH {POINTS} SELECT curve_id, {mean('freq BETWEEN 20 AND 100')} AS bass_mean, max(spl) FILTER (freq BETWEEN 20 AND 100) AS bass_peak,
  {mean('freq BETWEEN 2500 AND 3500')} AS pinna_mean, max(spl) FILTER (freq BETWEEN 2500 AND 3500) AS pinna_peak FROM pts GROUP BY 1""")
def band_metrics(spark, sf):
    return M.band_metrics(curves(spark, sf), {"bass": (20, 100), "pinna": (2500, 3500)})


# the axis of some curves is moved down or up, so that coverage and errors vary; no point is left out
MOVED = "CASE WHEN curve_id % 7 = 3 THEN 0.35 WHEN curve_id % 11 = 5 THEN 100 ELSE 1 END"
METRICS = f"""moved AS (SELECT curve_id, label, pos, spl, freq * {MOVED} AS freq FROM pts),
base AS (SELECT curve_id, label, count(*) AS n, max(freq) AS fmax, {REF} AS ref, {mean('freq BETWEEN 20 AND 100')} AS b,
  {mean('freq BETWEEN 500 AND 1500')} AS m, {mean('freq BETWEEN 2500 AND 3500')} AS p, CAST(max(spl) FILTER (freq BETWEEN 2500 AND 3500) AS DOUBLE) AS pp,
  {mean('freq BETWEEN 6000 AND 15000')} AS t, CAST(max(spl) FILTER (freq BETWEEN 6000 AND 15000) AS DOUBLE) AS tp FROM moved GROUP BY 1, 2),
mm AS (SELECT *, CASE WHEN n < 20 THEN 'too few points' WHEN ref IS NULL THEN 'no level near 1 kHz' END AS error, (least(15000.0, fmax) - 6000) / 9000.0 AS cover FROM base),
met AS (SELECT curve_id, label, error, cover, CASE WHEN error IS NULL THEN round_even(b - ref, 1)::DOUBLE + 0.0 END AS bass_shelf,
  CASE WHEN error IS NULL THEN round_even(m - ref, 1)::DOUBLE + 0.0 END AS mid_level, CASE WHEN error IS NULL THEN round_even(p - ref, 1)::DOUBLE + 0.0 END AS pinna_gain,
  CASE WHEN error IS NULL THEN round_even(pp - ref, 1)::DOUBLE + 0.0 END AS pinna_peak,
  CASE WHEN error IS NULL AND cover >= 0.25 THEN round_even(t - ref, 1)::DOUBLE + 0.0 END AS treble_avg,
  CASE WHEN error IS NULL AND cover >= 0.25 THEN round_even(tp - ref, 1)::DOUBLE + 0.0 END AS treble_peak,
  CASE WHEN error IS NULL AND cover < 0.25 THEN round_even(t - ref, 1)::DOUBLE + 0.0 END AS treble_avg_partial,
  CASE WHEN error IS NULL AND cover < 0.25 THEN round_even(tp - ref, 1)::DOUBLE + 0.0 END AS treble_peak_partial FROM mm)"""


def metrics(spark, sf):
    moved = curves(spark, sf).withColumn("freq", F.col("freq") * F.expr(MOVED).cast("double"))
    return M.curve_metrics(moved, ("curve_id", "label"))


@query("curve_metrics", f"""WITH {POINTS}, {METRICS} SELECT curve_id, error, bass_shelf, mid_level, pinna_gain, pinna_peak, treble_avg, treble_peak,
  treble_avg_partial, treble_peak_partial FROM met""")
def curve_metrics(spark, sf):
    return metrics(spark, sf).select(
        "curve_id", "error", "bass_shelf", "mid_level", "pinna_gain", "pinna_peak", "treble_avg", "treble_peak",
        "treble_avg_partial", "treble_peak_partial",
    )


TAGS = f"""{METRICS},
s1 AS (SELECT *, coalesce(pinna_gain, pinna_peak) AS pg FROM met WHERE error IS NULL),
s2 AS (SELECT *, coalesce((pg - 9.0) / 3.0, 0.0) + coalesce((treble_avg + 2.0) / 6.0, 0.0) + CASE WHEN treble_peak - pg > 6 THEN 0.4 ELSE 0.0 END AS score FROM s1),
s3 AS (SELECT *, score > 1.0 AND NOT (coalesce(bass_shelf >= 3, false) AND score < 2.0) AS bright, least(bass_shelf, pg - 7.0) AS fl FROM s2),
s4 AS (SELECT *, NOT bright AND score < -0.9 AS dark, coalesce(mid_level + 3.0 < fl, false) AS dip FROM s3),
r1 AS (SELECT *, list_filter([
  CASE WHEN bass_shelf > 8 THEN 'Basshead' END, CASE WHEN bass_shelf > 8 THEN 'Sub-Bass' END, CASE WHEN bass_shelf > 8 THEN 'Punchy Bass' END,
  CASE WHEN bass_shelf >= 3 AND bass_shelf <= 8 THEN 'Warm' END, CASE WHEN bass_shelf >= 3 AND bass_shelf <= 8 THEN 'Balanced' END,
  CASE WHEN bass_shelf >= 0 AND bass_shelf < 3 THEN 'Neutral' END, CASE WHEN bass_shelf >= 0 AND bass_shelf < 3 THEN 'Reference' END,
  CASE WHEN bright THEN 'Bright' END, CASE WHEN bright AND pg > 12 THEN 'Vocal-Focused' END,
  CASE WHEN bright AND treble_peak - pg > 6 THEN 'Treblehead' WHEN bright AND treble_avg > pg THEN 'Analytical' END,
  CASE WHEN dark THEN 'Smooth' END, CASE WHEN dark THEN 'Dark' END, CASE WHEN dark AND pg < 6 THEN 'Relaxed' END,
  CASE WHEN dip THEN CASE WHEN bass_shelf >= 6 THEN 'V-Shaped' ELSE 'U-Shaped' END
    WHEN abs(mid_level) <= 3 AND pg BETWEEN 8 AND 12 AND NOT bright AND NOT dark THEN 'Balanced' END], lambda x: x IS NOT NULL) AS t FROM s4),
r2 AS (SELECT *, list_filter(['V-Shaped', 'U-Shaped', 'Neutral', 'Balanced'], lambda x: list_contains(t, x))[1] AS prim FROM r1),
r3 AS (SELECT *, list_filter(t, lambda x: x NOT IN ('V-Shaped', 'U-Shaped', 'Neutral', 'Balanced') OR x = prim) AS t3 FROM r2),
r4 AS (SELECT *, CASE WHEN pg < 6 THEN list_filter(t3, lambda x: x NOT IN ('Bright', 'Treblehead', 'Analytical', 'Vocal-Focused')) ELSE t3 END AS t4 FROM r3),
r5 AS (SELECT *, CASE WHEN pg < 6 AND NOT list_has_any(t4, ['Smooth', 'Dark', 'Relaxed', 'Warm']) THEN list_append(t4, 'Relaxed') ELSE t4 END AS t5 FROM r4),
r6 AS (SELECT *, CASE WHEN list_contains(t5, 'Warm') THEN list_filter(t5, lambda x: x NOT IN ('Bright', 'Analytical')) ELSE t5 END AS t6 FROM r5),
r7 AS (SELECT *, CASE WHEN list_contains(t6, 'Basshead') THEN list_filter(t6, lambda x: x <> 'Treblehead') ELSE t6 END AS t7 FROM r6),
r8 AS (SELECT *, CASE WHEN prim = 'V-Shaped' THEN list_filter(t7, lambda x: x <> 'Vocal-Focused') ELSE t7 END AS t8 FROM r7),
tagged AS (SELECT curve_id, label, list_filter(t8, lambda x, i: list_position(t8, x) = i) AS tags FROM r8)"""


@query("suggest_tags", f"WITH {POINTS}, {TAGS} SELECT curve_id, array_to_string(tags, ',') AS tags FROM tagged")
def suggest_tags(spark, sf):
    tagged = M.curve_tags(metrics(spark, sf)).where("error IS NULL")
    return tagged.select("curve_id", F.array_join(F.transform("tags", lambda t: t["tag"]), ",").alias("tags"))


@query("vote_tags", f"""WITH {POINTS}, {TAGS},
f AS (SELECT label, count(*) AS n_files FROM tagged GROUP BY 1),
v AS (SELECT label, tag, count(*) AS votes, min(rank) AS best_rank FROM (SELECT label, unnest(tags) AS tag, generate_subscripts(tags, 1) - 1 AS rank FROM tagged) GROUP BY 1, 2)
SELECT label, tag, votes, best_rank, n_files, row_number() OVER (PARTITION BY label ORDER BY votes DESC, best_rank, tag) AS position
FROM v JOIN f USING (label) WHERE votes >= n_files // 2 + 1""")
def vote_tags(spark, sf):
    return M.vote_tags(M.curve_tags(metrics(spark, sf)), "label").select("label", "tag", "votes", "best_rank", "n_files", "position")


@query("mean_metrics", f"""WITH {POINTS}, {METRICS} SELECT label, count(*) AS n_files,
  round_even({mean('bass_shelf IS NOT NULL', 'CAST(bass_shelf AS DECIMAL(18,6))')}, 1)::DOUBLE + 0.0 AS bass_shelf,
  round_even({mean('treble_avg IS NOT NULL', 'CAST(treble_avg AS DECIMAL(18,6))')}, 1)::DOUBLE + 0.0 AS treble_avg FROM met WHERE error IS NULL GROUP BY 1""")
def mean_metrics(spark, sf):
    return M.mean_metrics(M.curve_tags(metrics(spark, sf)), "label").select("label", "n_files", "bass_shelf", "treble_avg")


@query("smooth_octaves", f"""WITH {POINTS}
SELECT curve_id, pos, CAST(sum(spl) OVER w AS DOUBLE) / count(*) OVER w AS spl FROM pts
WINDOW w AS (PARTITION BY curve_id ORDER BY log2(freq) RANGE BETWEEN 0.5::DOUBLE PRECEDING AND 0.5::DOUBLE FOLLOWING)""")
def smooth_octaves(spark, sf):
    return P.smooth_octaves(curves(spark, sf), 1.0).select("curve_id", "pos", "spl")


@query("smooth_dense", f"""WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice AS freq, CAST(l_quantity AS DECIMAL(18, 6)) AS spl FROM lineitem)
SELECT l_orderkey, l_linenumber, l_returnflag, CAST(sum(spl) OVER w AS DOUBLE) / count(*) OVER w AS spl FROM l
WINDOW w AS (PARTITION BY l_returnflag ORDER BY log2(freq) RANGE BETWEEN {1 / 24!r}::DOUBLE PRECEDING AND {1 / 24!r}::DOUBLE FOLLOWING)""")
def smooth_dense(spark, sf):
    """Three curves that hold all rows, a twelfth of an octave at a time: the mean quantity around a price."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_extendedprice").alias("freq"), F.col("l_quantity").alias("spl"))
    return P.smooth_octaves(lines, 1 / 12, ("l_returnflag",)).drop("freq")


@query("normalize_curve", f"""WITH {POINTS}, r AS (SELECT curve_id, {REF} AS ref FROM pts GROUP BY 1)
SELECT pts.curve_id, pts.pos, CAST(spl AS DOUBLE) - ref AS spl FROM pts JOIN r USING (curve_id)""")
def normalize_curve(spark, sf):
    return P.normalize_curve(curves(spark, sf)).select("curve_id", "pos", "spl")


# curves of a label cover different bands: each begins some grid steps further up
SHIFT = "curve_id % 5"


def shifted(spark, sf):
    place = F.col("pos") + F.expr(SHIFT)
    return curves(spark, sf).withColumn("freq", 20 * F.pow(F.lit(1000.0), place / STEP)).withColumn("pos", place)


@query("consensus_curve", f"""WITH {POINTS}, p AS (SELECT label, curve_id, pos + {SHIFT} AS pos, spl FROM pts),
e AS (SELECT label, curve_id, min(pos) AS lo, max(pos) AS hi FROM p GROUP BY 1, 2),
b AS (SELECT label, max(lo) AS lo, min(hi) AS hi, min(curve_id) AS base FROM e GROUP BY 1)
SELECT label, p.pos, CAST(sum(spl) AS DOUBLE) / count(*) AS spl, count(*) AS n_curves FROM p JOIN b USING (label)
WHERE p.pos BETWEEN b.lo AND b.hi GROUP BY 1, 2""")
def consensus_curve(spark, sf):
    out = P.consensus_curve(shifted(spark, sf), "label")
    return out.select("label", position().alias("pos"), "spl", "n_curves")


@query("overlap_bounds", f"""WITH {POINTS}, p AS (SELECT label, curve_id, pos + {SHIFT} AS pos, spl FROM pts),
e AS (SELECT label, curve_id, min(pos) AS lo, max(pos) AS hi FROM p GROUP BY 1, 2)
SELECT label, max(lo) AS lo, min(hi) AS hi, min(curve_id) AS first_curve, count(*) AS n_curves FROM e GROUP BY 1""")
def overlap_bounds(spark, sf):
    out = P.overlap_bounds(shifted(spark, sf), "label")
    return out.select("label", position("lo").alias("lo"), position("hi").alias("hi"), "first_curve", "n_curves")


def user_curve(spark, sf, kind=None):
    """curve_id = user (and kind, if not one kind is asked for), freq = minutes since the start of 2024, spl = value."""
    e = table(spark, sf, "events")
    e = e.where(F.col("event_type") == kind) if kind else e.withColumn("user_id", F.concat(F.col("user_id").cast("string"), "event_type"))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", start, F.col("ts").cast("timestamp_ntz"))
    return e.select(
        F.col("user_id").alias("curve_id"), (micros / 60_000_000.0).alias("freq"), F.col("value").cast("decimal(18,6)").alias("spl")
    )


DAY = "floor(freq / 1440)"
USERS = """ev AS (SELECT user_id AS curve_id, event_type, date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 60000000.0::DOUBLE AS freq, CAST(value AS DECIMAL(18, 6)) AS spl FROM events),
a AS (SELECT * FROM ev WHERE event_type = 'click'), b AS (SELECT * FROM ev WHERE event_type = 'view')"""
INTERP = """CASE WHEN l.freq IS NULL THEN CAST(r.spl AS DOUBLE) WHEN r.freq IS NULL OR l.freq = g.freq THEN CAST(l.spl AS DOUBLE)
  ELSE CAST(l.spl AS DOUBLE) + (g.freq - l.freq) / (r.freq - l.freq) * (CAST(r.spl AS DOUBLE) - CAST(l.spl AS DOUBLE)) END"""
ASOF = "ASOF LEFT JOIN b l ON l.curve_id = g.curve_id AND l.freq <= g.freq ASOF LEFT JOIN b r ON r.curve_id = g.curve_id AND r.freq >= g.freq"
BAND = """band AS (SELECT curve_id, greatest(a0, b0) AS lo, least(a1, b1) AS hi FROM (SELECT curve_id, min(freq) AS a0, max(freq) AS a1 FROM a GROUP BY 1)
  JOIN (SELECT curve_id, min(freq) AS b0, max(freq) AS b1 FROM b GROUP BY 1) USING (curve_id)),
g AS (SELECT a.* FROM a JOIN band USING (curve_id) WHERE freq BETWEEN lo AND hi),"""
ONTO = f"x AS (SELECT g.curve_id, g.freq, CAST(g.spl AS DOUBLE) AS sa, {INTERP} AS sb FROM g {ASOF})"


@query("interpolate", f"""WITH {USERS}, users AS (SELECT DISTINCT curve_id FROM b), g AS (SELECT a.* FROM a JOIN users USING (curve_id))
SELECT g.curve_id, g.freq, {INTERP} AS spl FROM g {ASOF}""")
def interpolate(spark, sf):
    """Views at the time of every click of a user who has views, clamped at the ends."""
    a, b = user_curve(spark, sf, "click"), user_curve(spark, sf, "view")
    grid = a.join(b.select("curve_id").distinct(), "curve_id", "left_semi").select("curve_id", "freq")
    return P.interpolate(b, grid, slice_of=DAY)


@query("average_pair", f"WITH {USERS}, {BAND} {ONTO} SELECT curve_id, freq, (sa + sb) / 2 AS spl FROM x")
def average_pair(spark, sf):
    return P.average_pair(user_curve(spark, sf, "click"), user_curve(spark, sf, "view"), slice_of=DAY)


@query("curve_diff", f"WITH {USERS}, {BAND} {ONTO} SELECT curve_id, freq, sa - sb AS diff FROM x")
def curve_diff(spark, sf):
    return P.curve_diff(user_curve(spark, sf, "click"), user_curve(spark, sf, "view"), slice_of=DAY)


HALVES = USERS[: USERS.index("\na AS")].replace("user_id AS curve_id", "user_id || event_type AS curve_id") + """
a AS (SELECT * FROM ev WHERE floor(freq / 720) % 2 = 0), b AS (SELECT * FROM ev WHERE floor(freq / 720) % 2 = 1)"""


@query("diff_summary", f"""WITH {HALVES}, {BAND} {ONTO}
SELECT curve_id, max(sa - sb) AS max_diff, CAST(sum(CAST(sa - sb AS DECIMAL(18, 6))) AS DOUBLE) / count(*) AS mean_diff, count(*) AS n FROM x GROUP BY 1""")
def diff_summary(spark, sf):
    """Every kind of event of every user before noon, next to the same after noon."""
    events, half = user_curve(spark, sf), F.expr("floor(freq / 720) % 2")
    return P.diff_summary(P.curve_diff(events.where(half == 0), events.where(half == 1), slice_of=DAY))


@query("pair_mismatch", f"""WITH {USERS}, {BAND} {ONTO}, m AS (SELECT curve_id, CAST(sum(CAST(abs(sa - sb) AS DECIMAL(18, 6))) AS DOUBLE) / count(*) AS m FROM x GROUP BY 1)
SELECT curve_id, CASE WHEN lo > hi THEN 'inf'::DOUBLE ELSE coalesce(m, 0.0) END AS mismatch FROM band LEFT JOIN m USING (curve_id)""")
def pair_mismatch(spark, sf):
    return P.pair_mismatch(user_curve(spark, sf, "click"), user_curve(spark, sf, "view"), slice_of=DAY)


@query("envelope_downsample", """WITH ev AS (SELECT user_id || event_type AS curve_id, date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 60000000.0::DOUBLE AS freq, CAST(value AS DECIMAL(18, 6)) AS spl
  FROM events)
SELECT curve_id, CAST(floor(freq / 43200 * 40) AS BIGINT) AS bucket, min(spl) AS lo, max(spl) AS hi, count(*) AS n FROM ev GROUP BY 1, 2""")
def envelope_downsample(spark, sf):
    """Every kind of event of every user is a curve."""
    return P.envelope_downsample(user_curve(spark, sf), 40, place=F.col("freq") / 43200)


@query("stride_downsample", f"""WITH {POINTS}, s AS (SELECT i FROM range(25) t(i)),
w AS (SELECT DISTINCT CAST(floor(i * (64 / 25.0)) AS BIGINT) AS pos FROM s) SELECT curve_id, pos, spl FROM pts WHERE pos IN (SELECT pos FROM w)""")
def stride_downsample(spark, sf):
    return P.stride_downsample(curves(spark, sf), 25).select("curve_id", "pos", "spl")


@query("axis_bounds", f"""WITH {POINTS}, e AS (SELECT label, CAST(min(spl) AS DOUBLE) - 3 AS lo, CAST(max(spl) AS DOUBLE) + 3 AS hi FROM pts GROUP BY 1),
m AS (SELECT label, CASE WHEN hi - lo < 20 THEN (hi + lo) / 2 - 10 ELSE lo END AS lo, CASE WHEN hi - lo < 20 THEN (hi + lo) / 2 + 10 ELSE hi END AS hi FROM e)
SELECT label, greatest(-60.0, floor(lo / 5) * 5.0) AS lo, least(40.0, ceil(hi / 5) * 5.0) AS hi FROM m""")
def axis_bounds(spark, sf):
    return M.axis_bounds(curves(spark, sf), ("label",))


# measurement lines out of events: four field styles, repeated frequencies, headers and date stamps
LINE_FREQ = "(event_id * 7919 % 3000 + 1)"


def event_lines(spark, sf):
    e = table(spark, sf, "events")
    freq = F.expr(f"CAST({LINE_FREQ} AS STRING)")
    level = F.col("value").cast("string")
    comma = F.replace(level, F.lit("."), F.lit(","))
    k = F.col("event_id") % 5
    line = (
        F.when(k == 0, F.concat(freq, F.lit("\t"), level))
        .when(k == 1, F.concat(freq, F.lit(";"), comma, F.lit(";0")))
        .when(k == 2, F.concat(F.lit("  "), freq, F.lit(","), level))
        .when(k == 3, F.concat(freq, F.lit("  "), level, F.lit(" nan")))
        .otherwise(F.concat(F.lit("2023,05,"), F.expr("CAST(event_id % 28 + 1 AS STRING)")))
    )
    head = F.when(F.col("event_id") % 97 == 0, F.concat(F.lit("# "), F.col("props"))).otherwise(line)
    return e.select(F.concat(F.lit("u"), "user_id").alias("path"), F.col("event_id").alias("line_order"), head.alias("line"))


LINES = f"""n AS (SELECT 'u' || user_id AS path, event_id, {LINE_FREQ} AS freq, value FROM events WHERE event_id % 5 <> 4 AND event_id % 97 <> 0 AND value BETWEEN -200 AND 200),
f AS (SELECT path, CAST(freq AS DOUBLE) AS freq, arg_min(value, event_id) AS spl FROM n GROUP BY 1, 2),
c AS (SELECT path, count(*) AS k, max(freq < 1900 OR freq > 2100) AS sweep FROM f GROUP BY 1)"""


@query("ingest_curves", f"""WITH {LINES} SELECT f.path AS curve_id, freq, spl FROM f JOIN c USING (path) WHERE k >= 2""")
def ingest_curves(spark, sf):
    points, _ = points_from_lines(event_lines(spark, sf))
    return points.select("curve_id", "freq", "spl")


@query("ingest_fr", """SELECT 'u' || user_id AS curve_id, CAST(CASE WHEN event_id % 5 = 4 THEN 2023 ELSE event_id * 7919 % 3000 + 1 END AS DOUBLE) AS freq,
  CASE WHEN event_id % 5 = 4 THEN 5.0 ELSE value END AS spl FROM events
WHERE event_id % 97 <> 0 AND CASE WHEN event_id % 5 = 4 THEN 2023 ELSE event_id * 7919 % 3000 + 1 END >= 2
  AND CASE WHEN event_id % 5 = 4 THEN 5.0 ELSE value END BETWEEN -120 AND 140""")
def ingest_fr(spark, sf):
    """The lenient reading of the same lines: no dedupe, dates are points like others."""
    points, _ = lenient_points_from_lines(event_lines(spark, sf))
    return points.select("curve_id", "freq", "spl")


FILE = """'in/' || CASE WHEN vec_id % 9 = 8 THEN 'Solo ' || vec_id WHEN vec_id % 9 < 4 THEN 'Unit ' || (vec_id // 9) || '-' || (vec_id % 9 // 2) || ' (' || (vec_id % 2 + 1) || ')'
  ELSE 'Side ' || (vec_id // 9) || '-' || (vec_id % 9 // 2) || CASE WHEN vec_id % 2 = 0 THEN ' L' ELSE '_r' END END || '.txt'"""


def file_name():
    return F.expr(FILE.replace("//", "div"))


@query("plan_groups", f"""WITH p AS (SELECT {FILE} AS path, vec_id FROM embeddings),
k AS (SELECT path, regexp_replace(regexp_replace(path, '^in/|\\.txt$', '', 'g'), '( \\([12]\\)|[ _][LlRr])$', '') AS key, path LIKE '%Solo%' AS solo FROM p),
g AS (SELECT key, count(*) AS n_sources, bool_or(solo) AS solo, min(path) AS first_path, max(path) AS last_path FROM k GROUP BY 1)
SELECT key, n_sources, n_sources = 2 AND NOT solo AS averaged, upper(key) || '.txt' AS out_name, first_path, CASE WHEN n_sources = 2 THEN last_path END AS second_path FROM g""")
def plan_groups(spark, sf):
    files, _ = queue_paths(table(spark, sf, "embeddings").select(file_name().alias("path")))
    return V.plan_groups(files)


@query("convert", f"""WITH {POINTS}, n AS (SELECT vec_id, {FILE} AS path FROM embeddings),
k AS (SELECT vec_id, path, regexp_replace(regexp_replace(path, '^in/|\\.txt$', '', 'g'), '( \\([12]\\)|[ _][LlRr])$', '') AS key FROM n),
g AS (SELECT key, count(*) AS c, min(path) AS p0, max(path) AS p1 FROM k GROUP BY 1),
w AS (SELECT g.key, a.vec_id AS va, b.vec_id AS vb FROM g JOIN n a ON a.path = p0 JOIN n b ON b.path = p1 WHERE c = 2),
d AS (SELECT w.key, CAST(sum(CAST(abs(CAST(x.spl AS DOUBLE) - CAST(y.spl AS DOUBLE)) AS DECIMAL(18, 6))) AS DOUBLE) / count(*) AS gap FROM w JOIN pts x ON x.curve_id = va JOIN pts y ON y.curve_id = vb AND y.pos = x.pos GROUP BY 1),
avg_pts AS (SELECT upper(w.key) || '.txt' AS curve_id, x.pos, (CAST(x.spl AS DOUBLE) + CAST(y.spl AS DOUBLE)) / 2 AS spl FROM w JOIN d USING (key)
  JOIN pts x ON x.curve_id = va JOIN pts y ON y.curve_id = vb AND y.pos = x.pos WHERE gap <= 10),
alone AS (SELECT k.vec_id, CASE WHEN k.path = g.p0 THEN upper(k.key) ELSE upper(regexp_replace(k.path, '^in/|\\.txt$', '', 'g')) END || '.txt' AS name
  FROM k JOIN g USING (key) LEFT JOIN d USING (key) WHERE gap IS NULL OR gap > 10)
SELECT * FROM avg_pts UNION ALL SELECT name, pos, CAST(spl AS DOUBLE) FROM alone JOIN pts ON pts.curve_id = vec_id""")
def convert(spark, sf):
    names = table(spark, sf, "embeddings").select(F.col("vec_id").alias("curve_id"), file_name().alias("path"))
    points = curves(spark, sf).join(names, "curve_id").select(F.col("path").alias("curve_id"), "freq", "spl")
    out, _ = V.convert(names.select("path"), points)
    return out.select("curve_id", position().alias("pos"), "spl")
