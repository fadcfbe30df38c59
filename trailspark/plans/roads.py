"""Roads and their lanes from the tracks alone, chains of fragments, and cars held back to the first frame."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailspark.operators import graph, kernels, windows
from trailspark.operators.lineage import python_workers, stored
from trailspark.params import Roads
from trailspark.plans import sql
from trailspark.plans.fields import _components_sql
from trailspark.plans.trk import TRK, query, rounded, trk


def lines_of(vertices: DataFrame, key: str, order: str) -> DataFrame:
    """(key, line): the segments of each polyline as one array of structs (seg, ax, ay, ux, uy, size, arc0), u being their direction; a line is one track or road, and short."""
    legs = windows._legs(vertices.select(key, order, "x", "y", F.lit(0.0).alias("t")), key, order).where("arc1 is not null")
    seg = (F.row_number().over(windows.along(key, order)) - 1).alias("seg")
    size = F.col("arc1") - F.col("arc")
    unit = lambda c: F.when(size > 0, (F.col(f"{c}1") - F.col(c)) / F.hypot(F.col("x1") - F.col("x"), F.col("y1") - F.col("y"))).otherwise(0.0).alias(f"u{c}")
    rows = legs.select(key, seg, F.col("x").alias("ax"), F.col("y").alias("ay"), unit("x"), unit("y"), F.hypot(F.col("x1") - F.col("x"), F.col("y1") - F.col("y")).alias("size"), F.col("arc").alias("arc0"))
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seg", "ax", "ay", "ux", "uy", "size", "arc0"))).alias("line"))


def on_line(x, y, line):
    """Struct (d, seg, s, off) of the nearest place on a polyline in a column, the first segment on ties; offset 0 is positive."""

    def place(g):
        once = lambda value, f: F.transform(F.array(value), f)[0]
        px, py = x - g["ax"], y - g["ay"]
        far = F.greatest(F.lit(0.0), F.least(g["size"], px * g["ux"] + py * g["uy"]))
        at = lambda u: F.struct(F.hypot(px - u * g["ux"], py - u * g["uy"]).alias("d"), g["seg"].alias("seg"), (g["arc0"] + u).alias("s"), (g["ux"] * py - g["uy"] * px < 0).alias("left"))
        return once(far, at)

    best = F.array_min(F.transform(line, place))
    return F.transform(F.array(best), lambda b: F.struct(b["d"].alias("d"), b["seg"].alias("seg"), b["s"].alias("s"), F.when(b["left"], -b["d"]).otherwise(b["d"]).alias("off")))[0]


def spines(members: DataFrame, car: float, p: Roads = Roads()) -> DataFrame:
    """(road, track_id) of the track with the longest way inside each road; roads whose longest is below four car lengths drop out."""
    w = Window.partitionBy("road", "track_id").orderBy("k")
    steps = members.withColumn("__d", F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)))
    ways = steps.groupBy("road", "track_id").agg(F.coalesce(F.sum("__d"), F.lit(0.0)).alias("way"))
    best = ways.groupBy("road").agg(F.max(F.struct("way", (-F.col("track_id")).alias("t"))).alias("b"))
    return best.where(F.col("b.way") >= p.min_spine * car).select("road", (-F.col("b.t")).alias("track_id"))


def centre_lines(near: DataFrame, p: Roads = Roads()) -> DataFrame:
    """(road, v, x, y): medians of ``near`` (road, s, x, y) in equal bins of station, smoothed; roads of few bins, or that wind by more than a turn, drop out.

    Bins are counted by Spark; a road's reach the kernel, a few dozen rows.
    """
    python_workers(near.sparkSession)
    longest = near.groupBy("road").agg(F.max("s").alias("__m"))
    bins = near.join(F.broadcast(longest), "road").where(F.col("s") < F.col("__m")).withColumn("bin", F.floor(F.col("s") / (F.col("__m") / p.bins)))
    bins = bins.groupBy("road", "bin").agg(F.count("*").alias("n"), F.percentile("x", F.lit(0.5)).alias("x"), F.percentile("y", F.lit(0.5)).alias("y")).where(F.col("n") >= p.min_in_bin)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin")
        x, y = (kernels.gaussian(rows[c], p.smooth) for c in "xy")
        turn = np.diff(np.arctan2(np.diff(y), np.diff(x)))
        winds = np.abs((turn + np.pi) % (2 * np.pi) - np.pi).sum() > 2 * np.pi
        keep = slice(0, 0 if winds or len(rows) < p.min_bins else None)
        return pd.DataFrame({"road": rows["road"].to_numpy()[keep], "v": np.arange(len(rows))[keep], "x": x[keep], "y": y[keep]})

    return bins.groupBy("road").applyInPandas(run, f"road {dict(near.dtypes)['road']}, v long, x double, y double")


def lanes(offsets: DataFrame, key: str, car: float, p: Roads = Roads()) -> DataFrame:
    """Lane centres and half-width of each road (``key``, ``off``): peaks of the smoothed histogram of offsets between two percentiles.

    Spark makes the histogram; only its bins reach the kernel.
    """
    python_workers(offsets.sparkSession)
    ends = offsets.groupBy(key).agg(F.percentile("off", F.lit(p.low)).alias("__lo"), F.percentile("off", F.lit(p.high)).alias("__hi"))
    n = F.greatest(F.ceil((F.col("__hi") - F.col("__lo")) / p.lane_bin), F.lit(1))
    rows = offsets.join(F.broadcast(ends), key).withColumn("__n", n).where((F.col("off") >= F.col("__lo")) & (F.col("off") <= F.col("__lo") + F.col("__n") * p.lane_bin))
    bins = rows.groupBy(key, "__lo", "__n", F.least(F.floor((F.col("off") - F.col("__lo")) / p.lane_bin), F.col("__n") - 1).alias("bin")).agg(F.count("*").alias("c"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        low, count = float(rows["__lo"].iloc[0]), int(rows["__n"].iloc[0])
        hist = np.bincount(rows["bin"].to_numpy(), rows["c"].to_numpy(), count)
        smooth = kernels.gaussian(hist, p.lane_smooth)
        apart = max(2, int(p.lane_part * car / p.lane_bin))
        found = kernels.peaks(smooth, apart, p.lane_rise * smooth.max())
        centres = (low + (found + 0.5) * p.lane_bin).tolist() or [0.0]
        half = float(np.median(np.diff(centres))) / 2 if len(centres) > 1 else p.lone_lane * car
        return pd.DataFrame({key: [rows[key].iloc[0]], "lanes": [centres], "lane_halfwidth": [half]})

    return bins.groupBy(key).applyInPandas(run, f"{key} {dict(offsets.dtypes)[key]}, lanes array<double>, lane_halfwidth double")


def infer(samples: DataFrame, car: float, p: Roads = Roads()) -> tuple[DataFrame, DataFrame]:
    """The roads of tracks (track_id, k, x, y): (road, v, x, y) of their centre lines, and (road, cells, n_obs, lanes, lane_halfwidth).

    Cells of like motion join into components, numbered from the largest. The track that
    goes farthest inside one is its spine; samples within 3.5 car lengths of it make the
    centre line, and their offsets from that the lanes.
    """
    cells = stored(graph.road_components(graph.flow_grid(samples, float(p.cell_px)), p.min_hits, p.max_angle_deg, p.min_cells).select(F.col("component").alias("road"), "cx", "cy", "size"))
    placed = samples.withColumns({"cx": F.floor(F.col("x") / p.cell_px), "cy": F.floor(F.col("y") / p.cell_px)})
    members = stored(placed.join(F.broadcast(cells), ["cx", "cy"]).select("road", "track_id", "k", "x", "y"))
    spine = stored(spines(members, car, p))
    lines = lines_of(samples.join(F.broadcast(spine), "track_id").select("road", "k", "x", "y"), "road", "k")
    # stored, as the filter would work out the places a second time
    placed = stored(members.join(F.broadcast(lines), "road").select("road", "x", "y", on_line(F.col("x"), F.col("y"), F.col("line")).alias("p")))
    near = placed.where(F.abs("p.off") < p.near * car).select("road", "x", "y", "p.s")
    counts = near.groupBy("road").agg(F.count("*").alias("n_obs")).where(F.col("n_obs") >= p.min_near)
    near = stored(near.join(F.broadcast(counts), "road"))
    centre = stored(centre_lines(near, p))
    again = near.join(F.broadcast(lines_of(centre, "road", "v")), "road")
    offsets = stored(again.select("road", on_line(F.col("x"), F.col("y"), F.col("line"))["off"].alias("off")))
    sizes = cells.groupBy("road").agg(F.first("size").alias("cells"))
    return centre, lanes(offsets, "road", car, p).join(sizes, "road").join(counts, "road").select("road", "cells", "n_obs", "lanes", "lane_halfwidth")


def road_samples(spark, sf_dir) -> DataFrame:
    """Tracks that drive along x in three lanes."""
    df = trk(spark, sf_dir)
    gone = F.sum(4 + F.col("track_id") % 5 * 0.5).over(windows.along().rowsBetween(Window.unboundedPreceding, 0))
    return df.select("track_id", "k", (gone + F.col("y") / 20).alias("x"), (24.0 * (F.col("track_id") % 3) + F.col("y") / 20 + 3).alias("y"))


CAR = 20.0
_P = Roads(min_cells=3, min_near=50)
_SAMPLES = f"{TRK}, rs AS (SELECT track_id, k, sum(4 + (track_id % 5) * 0.5) OVER (PARTITION BY track_id ORDER BY k)::DOUBLE + y / 20 AS x, 24.0 * (track_id % 3) + y / 20 + 3 AS y FROM trk)"


def _gauss(source: str, out: str, key: str, order: str, value: str, sigma: float) -> str:
    radius = int(4 * sigma + 0.5)
    return f"""{out}_k AS (SELECT j, exp(-0.5 * power(j / {sigma!r}, 2)) / sum(exp(-0.5 * power(j / {sigma!r}, 2))) OVER () AS w FROM range(-{radius}, {radius + 1}) r(j)),
{out}_n AS (SELECT {key}, {order}, {value} AS v, row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1 AS i, count(*) OVER (PARTITION BY {key}) AS n FROM {source}),
{out}_m AS (SELECT {key}, {order}, n, i, w, ((i + j) % (2 * n) + 2 * n) % (2 * n) AS m FROM {out}_n, {out}_k),
{out} AS (SELECT a.{key}, a.{order}, a.i, sum(a.w * b.v) AS v FROM {out}_m a JOIN {out}_n b ON b.{key} = a.{key} AND b.i = CASE WHEN m >= a.n THEN 2 * a.n - 1 - m ELSE m END GROUP BY ALL)"""


def _project(points: str, segments: str, out: str) -> str:
    return f"""{out}_p AS (SELECT p.*, g.seg, g.arc0, g.ax, g.ay, g.bx, g.by_, CASE WHEN g.bx = g.ax AND g.by_ = g.ay THEN 0 ELSE greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) END AS u FROM {points} p JOIN {segments} g USING (road)),
{out}_d AS (SELECT *, sqrt(power(x - ax - u * (bx - ax), 2) + power(y - ay - u * (by_ - ay), 2)) AS d FROM {out}_p),
{out}_r AS (SELECT *, row_number() OVER (PARTITION BY road, track_id, k ORDER BY d, seg) AS rk FROM {out}_d),
{out} AS (SELECT road, track_id, k, x, y, arc0 + u * sqrt(power(bx - ax, 2) + power(by_ - ay, 2)) AS s, CASE WHEN (bx - ax) * (y - ay) - (by_ - ay) * (x - ax) < 0 THEN -d ELSE d END AS off FROM {out}_r WHERE rk = 1)"""


def _segments(vertices: str, out: str) -> str:
    return f"""{out}_a AS (SELECT road, k, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by_ FROM {vertices} WINDOW w AS (PARTITION BY road ORDER BY k)),
{out} AS (SELECT *, row_number() OVER w - 1 AS seg, coalesce(sum(sqrt(power(bx - ax, 2) + power(by_ - ay, 2))) OVER (PARTITION BY road ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS arc0 FROM {out}_a WHERE bx IS NOT NULL WINDOW w AS (PARTITION BY road ORDER BY k))"""


_GRID = f"""{_SAMPLES}, st AS (SELECT floor(x / 24)::BIGINT AS cx, floor(y / 24)::BIGINT AS cy, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM rs WINDOW w AS (PARTITION BY track_id ORDER BY k)),
gr AS (SELECT cx, cy, count(*) AS hits, sum(dx) AS dx, sum(dy) AS dy FROM st WHERE dx IS NOT NULL GROUP BY cx, cy), c AS (SELECT cx, cy, atan2(dy, dx) AS way FROM gr WHERE hits >= 3 AND sqrt(dx * dx + dy * dy) > 1)"""
ROADS = f"""{_components_sql(_GRID, "least((abs(a.way - b.way)), 2 * pi() - abs(a.way - b.way)) < radians(55)", "abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 AND (a.cx <> b.cx OR a.cy <> b.cy)")},
sz AS (SELECT root, any_value(size) AS cells, row_number() OVER (ORDER BY any_value(size) DESC, root) AS road FROM ro GROUP BY root HAVING any_value(size) >= 3),
me AS (SELECT sz.road, rs.* FROM rs JOIN ro ON ro.cx = floor(rs.x / 24) AND ro.cy = floor(rs.y / 24) JOIN sz USING (root)),
wy AS (SELECT road, track_id, sum(coalesce(d, 0)) AS way FROM (SELECT road, track_id, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS d FROM me WINDOW w AS (PARTITION BY road, track_id ORDER BY k)) GROUP BY road, track_id),
sp AS (SELECT road, track_id FROM (SELECT *, row_number() OVER (PARTITION BY road ORDER BY way DESC, track_id) AS rk FROM wy) WHERE rk = 1 AND way >= 80),
sv AS (SELECT sp.road, rs.k, rs.x, rs.y FROM sp JOIN rs USING (track_id)), {_segments('sv', 'sg')}, {_project('me', 'sg', 'pj')},
nr AS (SELECT *, count(*) OVER (PARTITION BY road) AS n_obs, max(s) OVER (PARTITION BY road) AS smax FROM pj WHERE abs(off) < 70),
bn AS (SELECT road, floor(s / (smax / 36))::BIGINT AS bin, quantile_cont(x, 0.5) AS x, quantile_cont(y, 0.5) AS y FROM nr WHERE n_obs >= 50 AND s < smax GROUP BY 1, 2 HAVING count(*) >= 10),
{_gauss('bn', 'gx', 'road', 'bin', 'x', 3.0)}, {_gauss('bn', 'gy', 'road', 'bin', 'y', 3.0)},
cv AS (SELECT gx.road, gx.i AS k, gx.v AS x, gy.v AS y, count(*) OVER (PARTITION BY gx.road) AS n FROM gx JOIN gy USING (road, bin)),
hd AS (SELECT road, k, atan2(lead(y) OVER w - y, lead(x) OVER w - x) AS h FROM cv WINDOW w AS (PARTITION BY road ORDER BY k)),
tn AS (SELECT road, sum(least(d, 2 * pi() - d)) AS turn FROM (SELECT road, abs(h - lag(h) OVER (PARTITION BY road ORDER BY k)) AS d FROM hd) GROUP BY road),
cl AS (SELECT cv.* FROM cv JOIN tn USING (road) WHERE n >= 4 AND turn <= 2 * pi())"""


@query(f"WITH RECURSIVE {ROADS} SELECT road::INT AS road, k AS v, round(x, 4) AS x, round(y, 4) AS y FROM cl")
def road_lines(spark, sf_dir):
    """Centre lines of the roads that tracks in three lanes make."""
    return rounded(infer(road_samples(spark, sf_dir), CAR, _P)[0], 4)


@query(
    f"""WITH RECURSIVE {ROADS}, {_segments('cl', 'cs')}, np AS (SELECT road, track_id, k, x, y FROM nr WHERE n_obs >= 50), {_project('np', 'cs', 'of')},
en AS (SELECT road, quantile_cont(off, 0.02) AS lo, greatest(1, ceil((quantile_cont(off, 0.98) - quantile_cont(off, 0.02)) / 4))::BIGINT AS n FROM of GROUP BY road),
hi AS (SELECT road, lo, n, least(floor((off - lo) / 4)::BIGINT, n - 1) AS bin, count(*) AS c FROM of JOIN en USING (road) WHERE off >= lo AND off <= lo + n * 4 GROUP BY ALL),
hf AS (SELECT en.road, unnest(range(n)) AS bin FROM en), hh AS (SELECT hf.road, hf.bin, coalesce(c, 0) AS c FROM hf LEFT JOIN hi USING (road, bin)), {_gauss('hh', 'hs', 'road', 'bin', 'c', 1.6)},
pk AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b, max(v) OVER (PARTITION BY road) AS top FROM hs WINDOW w AS (PARTITION BY road ORDER BY i)),
pp AS (SELECT p.road, p.i, p.v, p.top, (SELECT coalesce(max(q.i), -1) FROM hs q WHERE q.road = p.road AND q.i < p.i AND q.v > p.v) AS l, (SELECT coalesce(min(q.i), 1000000) FROM hs q WHERE q.road = p.road AND q.i > p.i AND q.v > p.v) AS r FROM pk p WHERE v > a AND v > b),
pr AS (SELECT road, i, v - greatest((SELECT min(q.v) FROM hs q WHERE q.road = pp.road AND q.i BETWEEN l AND pp.i), (SELECT min(q.v) FROM hs q WHERE q.road = pp.road AND q.i BETWEEN pp.i AND r)) AS rise, top FROM pp),
ln AS (SELECT road, list(lo + (i + 0.5) * 4 ORDER BY i) AS lanes FROM pr JOIN en USING (road) WHERE rise >= 0.12 * top GROUP BY road),
ob AS (SELECT road, any_value(n_obs) AS n_obs FROM nr GROUP BY road)
SELECT sz.road::INT AS road, cells, n_obs, list_transform(coalesce(lanes, [0.0]), lambda v: round(v, 3)) AS lanes,
  round(CASE WHEN len(lanes) > 1 THEN list_median(list_transform(range(2, len(lanes) + 1), lambda j: lanes[j] - lanes[j - 1])) / 2 ELSE 7.0 END, 3) AS lane_halfwidth FROM sz JOIN ob USING (road) LEFT JOIN ln USING (road) WHERE road IN (SELECT road FROM cl)"""
)
def road_lanes(spark, sf_dir):
    """Their lanes, by the offsets from the centre lines."""
    found = infer(road_samples(spark, sf_dir), CAR, _P)[1]
    return found.select("road", "cells", "n_obs", F.transform("lanes", lambda v: F.round(v, 3)).alias("lanes"), F.round("lane_halfwidth", 3).alias("lane_halfwidth"))
