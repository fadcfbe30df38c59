"""Composite tables that users read: scene dots and draw lists, focus rows, recovered focus lanes, the full quality report, and rules over measured tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailspark.functions import geometry as g
from trailspark.operators import windows
from trailspark.params import Focus, Kinematics
from trailspark.plans import sql
from trailspark.plans.approaches import kinematics_report
from trailspark.plans.fields import waves
from trailspark.plans.intervals import focus_ids
from trailspark.plans.kinematics import H, POLYLINE, _sql_project
from trailspark.plans.roads import ROADS, _P, CAR, infer, road_samples
from trailspark.plans.scene import absorbed, entry_speeds, stitch, stitch_candidates, trails
from trailspark.plans.shapes import _vertices, vertex_station
from trailspark.plans.trk import HIGH, LOW, ORACLE, TRK, query, rounded, trk
from trailspark.plans.world import World, backfill, displayed_states, parked_flow


def scene_dots(samples: DataFrame, v_stop: float, half: int = 2) -> DataFrame:
    """(track_id, k, x, y, heading, state): headings of the path's gradient, carried while a car stands (0 before it moves), smoothed, and turned to the net motion; moving, slow or stopped."""
    df = samples.withColumn("__i", F.col("k").cast("double"))
    way = F.atan2(windows.gradient("y", "__i"), windows.gradient("x", "__i"))
    df = df.withColumn("__raw", F.when(F.col("speed") > v_stop, way))
    df = df.withColumn("__held", F.coalesce(F.last("__raw", ignorenulls=True).over(windows.along().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    df = df.withColumn("heading", windows.circular_mean("__held", half))
    state = F.when(F.col("speed") < v_stop, "stopped").when(F.col("speed") < 2 * v_stop, "slow").otherwise("moving")
    return windows.flip_headings(df.withColumn("state", state), samples).select("track_id", "k", "x", "y", "heading", "state")


_DOT_GRADIENT = "CASE WHEN {v}0 IS NOT NULL AND {v}1 IS NOT NULL THEN ({v}1 - {v}0) / 2 WHEN {v}1 IS NOT NULL THEN {v}1 - {v} ELSE {v} - {v}0 END"


@query(
    f"""WITH {TRK}, s AS (SELECT *, lag(x) OVER w AS x0, lead(x) OVER w AS x1, lag(y) OVER w AS y0, lead(y) OVER w AS y1 FROM trk WINDOW w AS (PARTITION BY track_id ORDER BY k)),
r AS (SELECT *, CASE WHEN speed > {LOW} THEN atan2({_DOT_GRADIENT.format(v='y')}, {_DOT_GRADIENT.format(v='x')}) END AS raw FROM s),
h AS (SELECT *, coalesce(last_value(raw IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY k), 0) AS held FROM r),
c AS (SELECT *, atan2(avg(sin(held)) OVER w, avg(cos(held)) OVER w) AS way, arg_max(x, k) OVER (PARTITION BY track_id) - arg_min(x, k) OVER (PARTITION BY track_id) AS nx, arg_max(y, k) OVER (PARTITION BY track_id) - arg_min(y, k) OVER (PARTITION BY track_id) AS ny FROM h WINDOW w AS (PARTITION BY track_id ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
f AS (SELECT *, abs(way - atan2(ny, nx)) AS gap FROM c)
SELECT track_id, k, round(cos(CASE WHEN (nx <> 0 OR ny <> 0) AND least(gap, 2 * pi() - gap) > pi() / 2 THEN way + pi() ELSE way END), 4) AS cx, CASE WHEN speed < {LOW} THEN 'stopped' WHEN speed < {2 * LOW} THEN 'slow' ELSE 'moving' END AS state FROM f"""
)
def dots(spark, sf_dir):
    out = scene_dots(trk(spark, sf_dir), LOW)
    return out.select("track_id", "k", F.round(F.cos("heading"), 4).alias("cx"), "state")


@query(
    f"""WITH {TRK}, s AS (SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS step FROM trk WINDOW w AS (PARTITION BY track_id ORDER BY k)),
z AS (SELECT track_id, k, x, y, sqrt(power(x - first_value(x) OVER f, 2) + power(y - first_value(y) OVER f, 2)) AS chord, coalesce(sum(step) OVER t, 0) AS trail FROM s
  WINDOW f AS (PARTITION BY track_id ORDER BY k ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), t AS (PARTITION BY track_id ORDER BY k ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT track_id, k, round(x, 6) AS x, round(y, 6) AS y, coalesce(chord / nullif(trail, 0) >= 0.8, false) AND trail >= 25 AS trail FROM z"""
)
def draw_list(spark, sf_dir):
    """What is drawn at each frame: every car's dot, and its trail where that is straight and half a car long."""
    out = trails(trk(spark, sf_dir), 5)
    return rounded(out.select("track_id", "k", "x", "y", (F.col("straight") & (F.col("trail") >= 25)).alias("trail")))


def focus_rows(samples: DataFrame, ids: DataFrame, states: DataFrame, line: list[tuple[float, float]]) -> DataFrame:
    """(track_id, k, t, s, off, state): stations of the focus cars along a guide's vertices, with their displayed states."""
    rows = samples.join(ids.select("track_id"), "track_id", "left_semi").withColumn("__p", vertex_station(F.col("x"), F.col("y"), line))
    return rows.join(states.select("track_id", "k", "state"), ["track_id", "k"]).select("track_id", "k", "t", "__p.s", "__p.off", "state")


@query(
    f"""WITH RECURSIVE {TRK}, {sql.three_states('trk', 'q3', LOW, HIGH, 5)}, v(v, vx, vy, arc, tx, ty) AS (VALUES {_vertices()}), fi AS (SELECT track_id FROM ({ORACLE['focus_ids']})),
r AS (SELECT track_id, k, t, arc, sqrt(power(x - vx, 2) + power(y - vy, 2)) AS d, tx * (y - vy) - ty * (x - vx) AS side, v FROM trk, v WHERE track_id IN (SELECT track_id FROM fi)),
n AS (SELECT *, row_number() OVER (PARTITION BY track_id, k ORDER BY d, v) AS rk FROM r) SELECT n.track_id, n.k, round(t, 3) AS t, round(arc, 6) AS s, round(CASE WHEN side < 0 THEN -d ELSE d END, 6) AS off, q3.state FROM n JOIN q3 ON q3.track_id = n.track_id AND q3.k = n.k WHERE rk = 1"""
)
def focus_lane_rows(spark, sf_dir):
    df = trk(spark, sf_dir)
    none = spark.createDataFrame([], "track_id long, frame long, state string")
    states, _ = displayed_states(df, none, 25.0, LOW, HIGH)
    out = focus_rows(df, focus_ids(spark, sf_dir), states, POLYLINE)
    return out.select("track_id", "k", F.round("t", 3).alias("t"), F.round("s", 6).alias("s"), F.round("off", 6).alias("off"), "state")


def recover(samples: DataFrame, manual: DataFrame, focus: DataFrame, car: float, v_stop: float, fps: float, max_gap_s: float = Focus.max_gap_s, stitched_by=None) -> DataFrame:
    """The samples of the focus lane made whole: manual tracks united, early fragments chained on, standing cars held back to the first frame, and gaps bridged.

    ``samples`` and ``manual`` have track_id, frame, t, x, y, speed and, for the chains, s and
    off along the guide. Rows that were filled have ``filled``.
    """
    every = samples.unionByName(manual, allowMissingColumns=True)
    order = every.withColumn("k", F.col("frame"))
    ends = order.groupBy("track_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.min_by("s", "k").alias("s0"), F.max_by("s", "k").alias("s1"), F.min_by("off", "k").alias("lat0"), F.max_by("off", "k").alias("lat1"), F.count("*").alias("n"))
    parts = ends.join(entry_speeds(order), "track_id")
    pairs = stitch_candidates(parts, max_gap_s).join(ends.where((F.col("n") >= 3) | (F.col("track_id") < 0)).select(F.col("track_id").alias("tail")), "tail", "left_semi")
    pairs = pairs.join(focus.select(F.col("track_id").alias("__f")), F.col("head") == F.col("__f"), "left").withColumn("clip", F.lit(0))
    chains = stitch(pairs.drop("__f"), car)
    whole = absorbed(every, chains)
    back = backfill(whole, focus, car, v_stop).select("track_id", "frame", "x", "y").withColumns({"t": F.col("frame") / F.lit(float(fps)), "speed": F.lit(0.0)})
    lane = whole.join(focus.select("track_id"), "track_id", "left_semi").select("track_id", "frame", "t", "x", "y", "speed").unionByName(back.select("track_id", "frame", "t", "x", "y", "speed"))
    return windows.gap_fill(lane, ["t", "x", "y", "speed"])


def full_report(found: World, events: DataFrame, fps: float, boots: int = 2000) -> DataFrame:
    """The whole quality report of a world in one row: kinematics, parked speeds in car lengths, and the wave by wavelet and by crossing times."""
    p = Kinematics()
    jerk = 15.0 / 4.5 * found.car_len
    row = kinematics_report(found.samples, found.runs, found.car_len, jerk)
    still = found.tracks.where("static")
    seen = found.samples.where("zv_mag is not null").select("track_id", (F.col("zv_mag") / found.car_len).alias("m")).join(still.select("track_id"), "track_id", "left_semi")
    per = seen.groupBy("track_id").agg(F.percentile("m", F.lit(0.5)).alias("m"), F.count("*").alias("n")).where("n >= 10")
    bias = still.select((F.hypot("zv_med_x", "zv_med_y") / found.car_len).alias("b")).where("b is not null")
    row = row.crossJoin(per.agg(F.percentile("m", F.lit(0.5)).alias("parked_corrected"), F.count("*").alias("n_parked"))).crossJoin(bias.agg(F.percentile("b", F.lit(0.5)).alias("parked_bias"), F.percentile("b", F.lit(0.9)).alias("parked_bias_p90")))
    for name, time in (("wave", "t_wav"), ("wave_crossing", "t")):
        w = waves(found.samples, events.withColumn("t", F.col(time)), found.car_len, p.v_move * found.car_len, boots=boots)
        row = row.crossJoin(w.agg(*[F.first(c).alias(f"{name}_{c}") for c in ("slope", "low", "high", "kmh", "mad", "n", "in_band", "backward")]))
    return row


def corner_flow(corners: DataFrame, min_corners: int = 4, fb: float = 0.6, spread: float = 1.5) -> DataFrame:
    """(track_id, frame, vx, vy, n, spread): the median displacement of a track's corner pairs (x0, y0 to x1, y1, with the forward-backward error ``err`` and scale ``jac``) of a frame.

    Pairs whose error reaches ``fb`` are left out; frames with fewer than ``min_corners`` others, or whose
    median distance from the median displacement exceeds ``spread`` times the scale, give no row.
    """
    c = corners.where(F.col("err") < fb).withColumns({"dx": F.col("x1") - F.col("x0"), "dy": F.col("y1") - F.col("y0")})
    w = Window.partitionBy("track_id", "frame")
    c = c.withColumns({"mx": F.percentile("dx", F.lit(0.5)).over(w), "my": F.percentile("dy", F.lit(0.5)).over(w)})
    out = c.groupBy("track_id", "frame").agg(F.first("mx").alias("vx"), F.first("my").alias("vy"), F.count("*").alias("n"), F.percentile(F.hypot(F.col("dx") - F.col("mx"), F.col("dy") - F.col("my")), F.lit(0.5)).alias("spread"), F.max("jac").alias("jac"))
    return out.where((F.col("n") >= min_corners) & (F.col("spread") <= spread * F.col("jac"))).select("track_id", "frame", "vx", "vy", "n", "spread")


@query(
    f"""WITH {TRK}, c AS (SELECT track_id, floor(k / 8)::BIGINT AS frame, {_sql_project('x', 'y')[0]} AS x0, {_sql_project('x', 'y')[1]} AS y0, {_sql_project('x + 2 + speed / 400', 'y - 1 + speed / 300')[0]} AS x1, {_sql_project('x + 2 + speed / 400', 'y - 1 + speed / 300')[1]} AS y1, y / 100 AS err FROM trk),
d AS (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy FROM c WHERE err < 0.6), m AS (SELECT *, quantile_cont(dx, 0.5) OVER w AS mx, quantile_cont(dy, 0.5) OVER w AS my FROM d WINDOW w AS (PARTITION BY track_id, frame))
SELECT track_id, frame, round(any_value(mx), 6) AS vx, round(any_value(my), 6) AS vy, count(*) AS n, round(quantile_cont(sqrt(power(dx - mx, 2) + power(dy - my, 2)), 0.5), 6) AS spread FROM m GROUP BY track_id, frame HAVING count(*) >= 4 AND quantile_cont(sqrt(power(dx - mx, 2) + power(dy - my, 2)), 0.5) <= 0.3 * 1.0"""
)
def corner_velocities(spark, sf_dir):
    """Corner pairs under a homography, eight samples of a track standing for the corners of a frame."""
    x, y, v = F.col("x"), F.col("y"), F.col("speed")
    (x0, y0), (x1, y1) = g.project(H, x, y), g.project(H, x + 2 + v / 400, y - 1 + v / 300)
    rows = trk(spark, sf_dir).select("track_id", F.floor(F.col("k") / 8).alias("frame"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), (y / 100).alias("err"), F.lit(1.0).alias("jac"))
    return rounded(corner_flow(rows, spread=0.3))


@query(f"WITH {TRK} SELECT track_id, k, round(1 + (1.2 - 1) * least(1, k / 50), 9) AS a, round(5.0 * least(1, k / 50), 9) AS c FROM trk")
def blended_matrices(spark, sf_dir):
    """A correction that fades in: matrices between the identity and another one, element by element."""
    part = F.least(F.lit(1.0), F.col("k") / 50)
    blend = lambda a, b: F.lit(a) + (F.lit(b) - F.lit(a)) * part
    return rounded(trk(spark, sf_dir).select("track_id", "k", blend(1.0, 1.2).alias("a"), blend(0.0, 5.0).alias("c")), 9)


def arbitrated(candidates: DataFrame, near: float = 12.0) -> DataFrame:
    """(frame, choice) of candidates (frame, delta, direct_vote, chain_vote): the direct one while both agree within ``near``, else the one of the lesser vote; a missing vote loses, and direct wins ties."""
    vote = F.coalesce("chain_vote", F.lit(math.inf)) < F.coalesce("direct_vote", F.lit(math.inf))
    return candidates.select("frame", F.when(F.col("delta") <= near, "direct").when(vote, "chain").otherwise("direct").alias("choice"))


@query(f"WITH {TRK}, c AS (SELECT track_id, k, speed / 8 AS delta, CASE WHEN k % 7 = 0 THEN NULL ELSE x END AS d, CASE WHEN k % 5 = 0 THEN NULL ELSE y * 3 END AS c FROM trk) SELECT track_id, k AS frame, CASE WHEN delta <= 12 THEN 'direct' WHEN coalesce(c, 'infinity'::DOUBLE) < coalesce(d, 'infinity'::DOUBLE) THEN 'chain' ELSE 'direct' END AS choice FROM c")
def keyframe_choices(spark, sf_dir):
    k = F.col("k")
    rows = trk(spark, sf_dir).select(F.struct("track_id", "k").alias("frame"), (F.col("speed") / 8).alias("delta"), F.when(k % 7 != 0, F.col("x")).alias("direct_vote"), F.when(k % 5 != 0, F.col("y") * 3).alias("chain_vote"))
    return arbitrated(rows).select("frame.track_id", F.col("frame.k").alias("frame"), "choice")


def toggled(band: DataFrame, wanted: DataFrame) -> DataFrame:
    """(track_id, list): how the wanted set differs from the band's: those to include and those to exclude."""
    more = wanted.select("track_id").join(band.select("track_id"), "track_id", "left_anti").distinct().withColumn("list", F.lit("include"))
    less = band.select("track_id").join(wanted.select("track_id"), "track_id", "left_anti").distinct().withColumn("list", F.lit("exclude"))
    return more.unionByName(less)


@query(f"WITH {TRK}, i AS (SELECT track_id, quantile_cont(y, 0.5) AS m FROM trk GROUP BY track_id) SELECT track_id, CASE WHEN m > 55 THEN 'include' ELSE 'exclude' END AS list FROM i WHERE (m > 45 AND m <= 50) OR m > 55")
def focus_toggles(spark, sf_dir):
    m = trk(spark, sf_dir).groupBy("track_id").agg(F.percentile("y", F.lit(0.5)).alias("m"))
    return toggled(m.where("m > 45 and m <= 55"), m.where("m > 50"))


@query(f"WITH {TRK} SELECT track_id, list(k ORDER BY k) AS frames, list(round(x, 1) ORDER BY k) AS x, list(round(y, 1) ORDER BY k) AS y, list(round(speed, 1) ORDER BY k) AS speed FROM trk GROUP BY track_id")
def track_arrays(spark, sf_dir):
    """Tracks as parallel arrays of rounded values, one row each."""
    p = F.array_sort(F.collect_list(F.struct("k", *[F.round(c, 1).alias(c) for c in ("x", "y", "speed")])))
    return trk(spark, sf_dir).groupBy("track_id").agg(p.alias("p")).select("track_id", F.col("p.k").alias("frames"), "p.x", "p.y", "p.speed")


def between(boundaries) -> tuple:
    """Lane centres (midpoints) and half-width (half the median gap) of sorted lane boundaries in an array column."""
    n = F.size(boundaries)
    gaps = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.get(boundaries, i) - F.get(boundaries, i - 1))
    middle = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (F.get(boundaries, i) + F.get(boundaries, i - 1)) / 2)
    ranked = F.array_sort(gaps)
    half = (F.get(ranked, ((n - 2) / 2).cast("int")) + F.get(ranked, ((n - 1) / 2).cast("int"))) / 4
    return F.when(n > 1, middle).otherwise(F.array().cast("array<double>")), F.when(n > 1, half)


@query(f"SELECT road, list_transform(range(2, len(lanes) + 1), lambda j: round((lanes[j] + lanes[j - 1]) / 2, 2)) AS centres, round(list_median(list_transform(range(2, len(lanes) + 1), lambda j: lanes[j] - lanes[j - 1])) / 2, 2) AS half FROM ({ORACLE['road_lanes']})")
def paint_lanes(spark, sf_dir):
    """Lanes between marks of paint: the peaks over a road's offsets taken as its painted boundaries."""
    marks = infer(road_samples(spark, sf_dir), CAR, _P)[1].withColumn("b", F.transform("lanes", lambda v: F.round(v, 3)))
    centres, half = between(F.col("b"))
    return marks.select("road", F.transform(centres, lambda v: F.round(v, 2)).alias("centres"), F.round(half, 2).alias("half"))
