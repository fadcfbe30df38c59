"""Scalar functions, grids, orders and small joins as queries over the trajectory view."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailspark.functions import geometry as g
from trailspark.operators import graph, joins, sequences, windows
from trailspark.plans import sql
from trailspark.plans.fields import GRID, _components_sql
from trailspark.plans.kinematics import POLYLINE, STATION, _sql_project, with_station
from trailspark.plans.kinematics import H as HOMOGRAPHY
from trailspark.plans.trk import HIGH, LOW, TRK, query, rounded, trk

OTHER = (0.9, -0.05, 12.0, 0.03, 1.05, -4.0, -1e-4, 1e-4, 1.02)


def _product(p, q) -> list[float]:
    return [sum(p[3 * r + k] * q[3 * k + c] for k in range(3)) for r in range(3) for c in range(3)]


@query(
    f"WITH {TRK}, m(i, v) AS (VALUES {', '.join(f'({i}, {v!r}::DOUBLE)' for i, v in enumerate(_product(HOMOGRAPHY, OTHER)))}), n AS (SELECT max(CASE WHEN i = 8 THEN v END) AS z FROM m), "
    "o AS (SELECT (list(v / z ORDER BY i)) AS h FROM m, n) SELECT track_id, k, round((h[1] * x + h[2] * y + h[3]) / (h[7] * x + h[8] * y + h[9]), 6) AS wx, round((h[4] * x + h[5] * y + h[6]) / (h[7] * x + h[8] * y + h[9]), 6) AS wy, round(h[9], 9) AS last FROM trk, o"
)
def matrix_product(spark, sf_dir):
    """Places under the product of two homographies, divided by its last element."""
    h = g.normalised(g.product(HOMOGRAPHY, OTHER))
    wx, wy = g.project(h, F.col("x"), F.col("y"))
    return rounded(trk(spark, sf_dir).select("track_id", "k", wx.alias("wx"), wy.alias("wy"), h[8].alias("last")))


def guarded_scale(frames: DataFrame, low: float = 0.67, high: float = 1.5, key: str = "clip", order: str = "frame", value: str = "scale") -> DataFrame:
    """``frames`` with ``good`` and ``used``: a frame whose scale leaves low..high times that of the last good one is broken and takes it."""

    def run(frame):
        import pandas as pd

        out = []
        for v in frame[value].tolist():
            ok = not out or low <= v / out[-1][1] <= high
            out.append((ok, v if ok else out[-1][1]))
        return pd.concat([frame.reset_index(drop=True), pd.DataFrame(out, columns=["good", "used"])], axis=1)

    def each(frame):
        import pandas as pd

        return pd.concat([run(part) for _, part in frame.groupby(key, sort=False)], ignore_index=True)

    from trailspark.operators.smoothing import whole_groups

    return whole_groups(frames, key, [order], each, frames.withColumns({"good": F.lit(True), "used": F.lit(0.0)}).schema)


_SCALE = "100 * (1 + x / 900)"


@query(
    f"""WITH RECURSIVE {TRK}, fr AS (SELECT track_id AS clip, k AS frame, (abs(speed - 100) + 5) / 100 AS scale, row_number() OVER (PARTITION BY track_id ORDER BY k) AS i FROM trk),
gu AS (SELECT clip, frame, scale, i, true AS good, scale AS used FROM fr WHERE i = 1 UNION ALL
  SELECT f.clip, f.frame, f.scale, f.i, f.scale / g.used BETWEEN 0.67 AND 1.5, CASE WHEN f.scale / g.used BETWEEN 0.67 AND 1.5 THEN f.scale ELSE g.used END FROM gu g JOIN fr f ON f.clip = g.clip AND f.i = g.i + 1)
SELECT clip, frame, good, round(used, 6) AS used FROM gu"""
)
def broken_frames(spark, sf_dir):
    """Frames whose projection scale jumps, judged against the last good one."""
    rows = trk(spark, sf_dir).select(F.col("track_id").alias("clip"), F.col("k").alias("frame"), ((F.abs(F.col("speed") - 100) + 5) / 100).alias("scale"))
    return rounded(guarded_scale(rows).drop("scale"))


@query(f"WITH {TRK}, z AS (SELECT track_id, k, {_sql_project('x', 'y')[0]} AS a, {_sql_project('x', 'y')[1]} AS b, {_sql_project('x + 100', 'y')[0]} AS c, {_sql_project('x + 100', 'y')[1]} AS d FROM trk) SELECT track_id, k, round(sqrt((c - a) * (c - a) + (d - b) * (d - b)) / 100, 6) AS scale FROM z")
def projection_scales(spark, sf_dir):
    return rounded(trk(spark, sf_dir).select("track_id", "k", g.projection_scale(HOMOGRAPHY, F.col("x"), F.col("y")).alias("scale")))


@query(
    f"""WITH {TRK}, s AS (SELECT track_id, k, x, y, lead(x) OVER w AS bx, lead(y) OVER w AS by_ FROM trk WINDOW w AS (PARTITION BY track_id ORDER BY k)),
n AS (SELECT *, sqrt(power(bx - x, 2) + power(by_ - y, 2)) AS l, CASE WHEN -(by_ - y) * 1.0 + (bx - x) * 0.5 < 0 THEN -1 ELSE 1 END AS sg FROM s WHERE bx <> x OR by_ <> y)
SELECT track_id, k, round(-(by_ - y) / l * sg, 6) AS nx, round((bx - x) / l * sg, 6) AS ny, round((10 - x) * (-(by_ - y) / l * sg) + (20 - y) * ((bx - x) / l * sg), 5) AS dist FROM n"""
)
def oriented_normals(spark, sf_dir):
    """Unit normals of the steps, turned to one direction, and a point's signed distance from each step's line."""
    w = windows.along()
    s = trk(spark, sf_dir).select("track_id", "k", "x", "y", F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by")).where("bx <> x or by <> y")
    nx, ny = g.line_normal(*[F.col(c) for c in ("x", "y", "bx", "by")], 1.0, 0.5)
    s = s.withColumns({"nx": nx, "ny": ny})
    return s.select("track_id", "k", F.round("nx", 6).alias("nx"), F.round("ny", 6).alias("ny"), F.round(g.signed_distance(10.0, 20.0, F.col("x"), F.col("y"), F.col("nx"), F.col("ny")), 5).alias("dist"))


def vertex_station(x, y, line):
    """Struct (v, s, off) of the nearest vertex of a literal polyline: its number, its station, and the offset, signed by the side of the line there (0 positive)."""
    near = joins.nearest_vertex(x, y, line)
    arcs = [arc for *_, arc in joins.segments_of(line)] + [sum(math.dist(a, b) for a, b in zip(line, line[1:], strict=False))]
    at = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), near["v"] + 1)
    ends = [(line[min(i, len(line) - 2)], line[min(i, len(line) - 2) + 1]) for i in range(len(line))]
    tx, ty = at([b[0] - a[0] for a, b in ends]), at([b[1] - a[1] for a, b in ends])
    side = tx * (y - at([p[1] for p in line])) - ty * (x - at([p[0] for p in line]))
    return F.struct(near["v"].alias("v"), at(arcs).alias("s"), F.when(side < 0, -near["d"]).otherwise(near["d"]).alias("off"))


def _vertices() -> str:
    out, arc = [], 0.0
    for i, (x, y) in enumerate(POLYLINE):
        j = min(i, len(POLYLINE) - 2)
        (ax, ay), (bx, by) = POLYLINE[j], POLYLINE[j + 1]
        out.append(f"({i}, {x!r}, {y!r}, {arc!r}::DOUBLE, {bx - ax!r}, {by - ay!r})")
        if i + 1 < len(POLYLINE):
            arc += math.dist(POLYLINE[i], POLYLINE[i + 1])
    return ", ".join(out)


@query(
    f"""WITH {TRK}, v(v, vx, vy, arc, tx, ty) AS (VALUES {_vertices()}), r AS (SELECT track_id, k, v, arc, sqrt(power(x - vx, 2) + power(y - vy, 2)) AS d, tx * (y - vy) - ty * (x - vx) AS side FROM trk, v),
n AS (SELECT *, row_number() OVER (PARTITION BY track_id, k ORDER BY d, v) AS rk FROM r) SELECT track_id, k, v, round(arc, 6) AS s, round(CASE WHEN side < 0 THEN -d ELSE d END, 6) AS off FROM n WHERE rk = 1"""
)
def vertex_stations(spark, sf_dir):
    p = vertex_station(F.col("x"), F.col("y"), POLYLINE)
    return rounded(trk(spark, sf_dir).withColumn("p", p).select("track_id", "k", "p.*"))


@query(f"WITH {TRK} SELECT track_id, k, round((x * 3 + y * 4) / 5, 6) AS s, round((y * 3 - x * 4) / 5, 6) AS w FROM trk")
def rotated_places(spark, sf_dir):
    """Coordinates along and across an approach."""
    s, w = g.rotated(F.col("x"), F.col("y"), 3.0, 4.0)
    return rounded(trk(spark, sf_dir).select("track_id", "k", s.alias("s"), w.alias("w")))


def chevrons(line: list[tuple[float, float]], every: float, size: float) -> list[tuple[float, float, float, float, float, float]]:
    """Arrow heads along a polyline: tip and both ends of each, ``every`` apart."""
    out = []
    for _, ax, ay, bx, by, arc in joins.segments_of(line):
        length = math.dist((ax, ay), (bx, by))
        ux, uy = (bx - ax) / length, (by - ay) / length
        first = math.ceil(arc / every - 1e-9)
        for n in range(first, math.floor((arc + length - 1e-9) / every) + 1):
            at = n * every - arc
            x, y = ax + ux * at, ay + uy * at
            out.append((x, y, x - (ux - uy) * size, y - (uy + ux) * size, x - (ux + uy) * size, y - (uy - ux) * size))
    return out


def corridor(line: list[tuple[float, float]], reach: float) -> list[tuple[float, float]]:
    """A polyline made longer at both ends by ``reach``, each in the direction of its last segment."""
    (ax, ay), (bx, by) = line[0], line[1]
    n = math.dist(line[0], line[1])
    start = (ax - (bx - ax) / n * reach, ay - (by - ay) / n * reach)
    (ax, ay), (bx, by) = line[-2], line[-1]
    n = math.dist(line[-2], line[-1])
    return [start, *line, (bx + (bx - ax) / n * reach, by + (by - ay) / n * reach)]


@query(
    f"""WITH {TRK}, v AS (SELECT track_id, k, x, y, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS tx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS ty FROM trk WINDOW w AS (PARTITION BY track_id ORDER BY k))
SELECT track_id, k, round(x - ty / nullif(sqrt(tx * tx + ty * ty), 0) * 3, 6) AS x, round(y + tx / nullif(sqrt(tx * tx + ty * ty), 0) * 3, 6) AS y FROM v"""
)
def offset_lines(spark, sf_dir):
    """Tracks moved sideways along their normals, as the edges of lanes are."""
    from trailspark.plans.world import offset_line

    return rounded(offset_line(trk(spark, sf_dir), 3.0, "track_id", "k"))


@query(
    f"""WITH {TRK}, b AS (SELECT track_id, k, unnest([-1, 1, 1, -1]) AS a, unnest([-1, -1, 1, 1]) AS b, unnest([0, 1, 2, 3]) AS i, x, y, 20 + speed / 50 AS w, 10.0 AS h FROM trk),
c AS (SELECT track_id, k, i, x + a * w * 1.2 / 2 AS x, y + b * h * 1.2 / 2 AS y FROM b) SELECT track_id, k, i::INT AS i, round({_sql_project('x', 'y')[0]}, 6) AS x, round({_sql_project('x', 'y')[1]}, 6) AS y FROM c"""
)
def box_corners(spark, sf_dir):
    """The corners of boxes, grown by a fifth, under a homography."""
    quad = g.corners(F.col("x"), F.col("y"), 20 + F.col("speed") / 50, F.lit(10.0), 0.2)
    rows = trk(spark, sf_dir).select("track_id", "k", F.posexplode(quad).alias("i", "p"))
    wx, wy = g.project(HOMOGRAPHY, F.col("p.x"), F.col("p.y"))
    return rounded(rows.select("track_id", "k", "i", wx.alias("x"), wy.alias("y")))


DECK = [(0.0, 0.0), (400.0, 20.0), (420.0, 90.0), (10.0, 95.0)]


def deck_grid(spark, polygon, step: float) -> DataFrame:
    """Places of a square grid inside a polygon."""
    xs, ys = [p[0] for p in polygon], [p[1] for p in polygon]
    n = lambda v: int((max(v) - min(v)) / step)
    grid = spark.range(n(xs) + 1).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n(ys)).cast("long"))).alias("j"))
    grid = grid.withColumns({"x": min(xs) + F.col("i") * step, "y": min(ys) + F.col("j") * step})
    return grid.where(g.in_polygon(F.col("x"), F.col("y"), polygon))


def _pip(poly, x="x", y="y") -> str:
    parts = [f"CASE WHEN ({y} > {y0}) <> ({y} > {y1}) AND {x} < ({x1} - {x0}) * ({y} - {y0}) / ({y1} - {y0}) + {x0} THEN 1 ELSE 0 END" for (x0, y0), (x1, y1) in zip([poly[-1], *poly], poly, strict=False) if y0 != y1]
    return f"(({' + '.join(parts)}) % 2 = 1)"


@query(f"WITH gr AS (SELECT i, j, i * 7.0 AS x, j * 7.0 AS y FROM range(61) a(i), range(14) b(j)) SELECT i, j, x::DOUBLE AS x, y::DOUBLE AS y FROM gr WHERE {_pip(DECK)}")
def deck_samples(spark, sf_dir):
    return deck_grid(spark, DECK, 7.0)


@query(
    f"""WITH gr AS (SELECT i, j, i * 7.0 AS x, j * 7.0 AS y FROM range(61) a(i), range(14) b(j)), p AS (SELECT * FROM gr WHERE {_pip(DECK)}),
f AS (SELECT DISTINCT user_id AS f FROM events), d AS (SELECT f, sqrt(power(x + f / 50.0 - x, 2) + power(y * (1 + f / 5000.0) - y, 2)) AS d FROM p, f) SELECT f AS frame, round(quantile_cont(d, 0.5), 6) AS delta, quantile_cont(d, 0.5) <= 1.5 AS direct FROM d GROUP BY f"""
)
def homography_deltas(spark, sf_dir):
    """The median displacement of a grid between two homographies of each frame, and whether the frame keeps the direct one."""
    frames = trk(spark, sf_dir).select(F.col("track_id").alias("frame")).distinct()
    f = F.col("frame")
    frames = frames.select("frame", F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)]).alias("a"), F.array(F.lit(1.0), F.lit(0.0), f / 50.0, F.lit(0.0), 1 + f / 5000.0, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("b"))
    return rounded(homography_delta(frames, deck_grid(spark, DECK, 7.0)).select("frame", "delta", (F.col("delta") <= 1.5).alias("direct")))


def homography_delta(frames: DataFrame, grid: DataFrame) -> DataFrame:
    """(frame, delta): the median distance of the places of a (small, fixed) grid under the homographies ``a`` and ``b`` of each frame, arrays of nine."""
    rows = frames.join(F.broadcast(grid.select("x", "y")), F.lit(True))
    (ax, ay), (bx, by) = (g.project([F.col(c)[i] for i in range(9)], F.col("x"), F.col("y")) for c in ("a", "b"))
    return rows.groupBy("frame").agg(F.percentile(F.hypot(ax - bx, ay - by), F.lit(0.5)).alias("delta"))


@query("WITH s(a, w) AS (VALUES (1.5, 15), (4.0, 41)), p AS (SELECT a, w, unnest(range(w)) AS i FROM s) SELECT w::INT AS width, i::INT AS i, round(2 / sqrt(3 * a) / power(pi(), 0.25) * (1 - power((i - (w - 1) / 2.0) / a, 2)) * exp(-power((i - (w - 1) / 2.0) / a, 2) / 2), 9) AS v FROM p")
def ricker_values(spark, sf_dir):
    one = [spark.range(1).select(F.lit(w).alias("width"), F.posexplode(g.ricker(w, a)).alias("i", "v")) for a, w in ((1.5, 15), (4.0, 41))]
    return rounded(one[0].unionByName(one[1]), 9)


@query(f"WITH {TRK}, p AS (SELECT track_id, k, speed / 200 AS p FROM trk) SELECT track_id, k, round(1 - power(1 - greatest(0, least(1, p)), 3), 6) AS ease, round(sin(pi() * greatest(0, least(1, p))), 6) AS pulse FROM p")
def animation_curves(spark, sf_dir):
    p = F.col("speed") / 200
    return rounded(trk(spark, sf_dir).select("track_id", "k", g.ease_out(p).alias("ease"), g.pulse(p).alias("pulse")))


def hud_order(name, compass=("north", "east", "south", "west")):
    """A sort key that puts compass names first, in their order, then the others by name."""
    at = F.array_position(F.array(*[F.lit(c) for c in compass]), F.lower(name))
    return F.struct(F.when(at > 0, at).otherwise(len(compass) + 1).alias("group"), F.when(at > 0, F.lit("")).otherwise(name).alias("name"))


@query(f"WITH {TRK}, n AS (SELECT DISTINCT CASE cls WHEN 'click' THEN 'South' WHEN 'view' THEN 'north' ELSE cls END AS name FROM trk) SELECT name, (row_number() OVER (ORDER BY CASE lower(name) WHEN 'north' THEN 1 WHEN 'east' THEN 2 WHEN 'south' THEN 3 WHEN 'west' THEN 4 ELSE 5 END, name))::INT AS place FROM n")
def hud_places(spark, sf_dir):
    """Approach names in the order of the display: few rows."""
    names = trk(spark, sf_dir).select(F.when(F.col("cls") == "click", "South").when(F.col("cls") == "view", "north").otherwise(F.col("cls")).alias("name")).distinct()
    return names.select("name", F.row_number().over(Window.orderBy(hud_order(F.col("name")))).alias("place"))


@query(
    f"""WITH {TRK}, b AS (SELECT DISTINCT floor(t / 86400)::BIGINT AS d FROM trk), n AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS c FROM b)
SELECT d AS day, (row_number() OVER (ORDER BY abs(i - c // 2), i))::INT AS place FROM n"""
)
def middle_out(spark, sf_dir):
    """Days from the middle one outwards; the window is over days."""
    days = trk(spark, sf_dir).select(F.floor(F.col("t") / 86400).alias("day")).distinct()
    n = days.withColumn("i", F.row_number().over(Window.orderBy("day")) - 1).withColumn("c", F.count("*").over(Window.partitionBy()))
    return n.select("day", F.row_number().over(Window.orderBy(F.abs(F.col("i") - F.floor(F.col("c") / 2)), "i")).alias("place"))


_RANKED = _components_sql(
    f"{GRID}, c AS (SELECT cx, cy, atan2(dy, dx) AS way FROM gr WHERE hits >= 3 AND sqrt(dx * dx + dy * dy) > 1)",
    "least((abs(a.way - b.way)), 2 * pi() - abs(a.way - b.way)) < radians(55)",
    "abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 AND (a.cx <> b.cx OR a.cy <> b.cy)",
)


@query(f"WITH RECURSIVE {_RANKED}, sz AS (SELECT root, any_value(size) AS size FROM ro GROUP BY root), rk AS (SELECT root, row_number() OVER (ORDER BY size DESC, root) AS component FROM sz WHERE size >= 3) SELECT cx, cy, component::INT AS component FROM ro JOIN rk USING (root)")
def component_ranks(spark, sf_dir):
    """Road components numbered from the largest."""
    return graph.road_components(graph.flow_grid(trk(spark, sf_dir), 24.0), 3, 55.0, 3).select("cx", "cy", "component")


@query(f"WITH {TRK} SELECT DISTINCT a.track_id FROM trk a JOIN trk b USING (track_id) WHERE a.k = 3 AND b.k = 70")
def shared_tracks(spark, sf_dir):
    """Tracks that two frames share."""
    return joins.shared_ids(trk(spark, sf_dir), 3, 70, frame="k")


def stopped_vote(samples: DataFrame, pairs: DataFrame, v_stop: float, least: int = 12) -> DataFrame:
    """For each pair of frames (fa, fb) the lower-half median of the displacements of the tracks both share, null below ``least`` of them.

    Half of the shared tracks are taken to stand; the displacement of these says how well the frames fit.
    """
    a = samples.select("track_id", F.col("frame").alias("fa"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    b = samples.select("track_id", F.col("frame").alias("fb"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    both = pairs.join(a, "fa").join(b, ["fb", "track_id"]).withColumn("d", F.hypot(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")))
    w = Window.partitionBy("fa", "fb")
    low = both.withColumns({"__i": F.row_number().over(w.orderBy("d", "track_id")), "n": F.count("*").over(w)}).where(F.col("__i") <= F.greatest(F.floor(F.col("n") / 2), F.lit(1)))
    return low.groupBy("fa", "fb").agg(F.first("n").alias("n"), F.percentile("d", F.lit(0.5)).alias("vote")).withColumn("vote", F.when(F.col("n") >= least, F.col("vote")))


@query(
    f"""WITH {TRK}, p AS (SELECT unnest(range(0, 70, 7)) AS fa), b AS (SELECT fa, fa + 5 AS fb, a.track_id, sqrt(power(a.x - c.x, 2) + power(a.y - c.y, 2)) AS d FROM p JOIN trk a ON a.k = fa JOIN trk c ON c.k = fa + 5 AND c.track_id = a.track_id),
r AS (SELECT *, row_number() OVER (PARTITION BY fa ORDER BY d, track_id) AS i, count(*) OVER (PARTITION BY fa) AS n FROM b)
SELECT fa, fb, any_value(n) AS n, CASE WHEN any_value(n) >= 12 THEN round(quantile_cont(d, 0.5), 6) END AS vote FROM r WHERE i <= greatest(n // 2, 1) GROUP BY fa, fb"""
)
def stopped_votes(spark, sf_dir):
    pairs = spark.range(0, 70, 7).select(F.col("id").alias("fa"), (F.col("id") + 5).alias("fb"))
    return rounded(stopped_vote(trk(spark, sf_dir).withColumnRenamed("k", "frame"), pairs, LOW))


@query(
    f"""WITH {TRK}, c AS (SELECT track_id, k, atan2(y - 50, x - 100) AS a FROM trk)
SELECT track_id, k, round(atan2(avg(sin(a)) OVER w, avg(cos(a)) OVER w), 6) AS way FROM c WINDOW w AS (PARTITION BY track_id ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"""
)
def circular_smoothed(spark, sf_dir):
    df = trk(spark, sf_dir).withColumn("a", F.atan2(F.col("y") - 50, F.col("x") - 100))
    return rounded(df.select("track_id", "k", windows.circular_mean("a", 2).alias("way")))


@query(
    f"""WITH {TRK}, s AS (SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS step FROM trk WINDOW w AS (PARTITION BY track_id ORDER BY k)),
a AS (SELECT track_id, k, x, y, sum(coalesce(step, 0)) OVER (PARTITION BY track_id ORDER BY k) AS arc FROM s),
z AS (SELECT *, lead(arc) OVER w AS arc1, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM a WINDOW w AS (PARTITION BY track_id ORDER BY k)),
q AS (SELECT *, unnest(range(ceil(arc / 250)::BIGINT, ceil(arc1 / 250)::BIGINT)) AS i FROM z WHERE arc1 > arc)
SELECT track_id, i, round(x + (i * 250 - arc) / (arc1 - arc) * (x1 - x), 5) AS x, round(y + (i * 250 - arc) / (arc1 - arc) * (y1 - y), 5) AS y FROM q"""
)
def fixed_steps(spark, sf_dir):
    """Places every 250 along each track."""
    return rounded(windows.resample_steps(trk(spark, sf_dir), 250.0), 5)


@query(
    f"""WITH RECURSIVE {TRK}, fr AS (SELECT track_id AS clip, k AS frame, speed AS score, y / 10 AS shift, row_number() OVER (PARTITION BY track_id ORDER BY k) AS i, count(*) OVER (PARTITION BY track_id) AS n FROM trk),
kw AS (SELECT clip, frame, score, i, n, 1 AS c, shift AS gone, 1 AS win, 1 >= 12 OR shift >= 25 OR n = 1 AS done FROM fr WHERE i = 1 UNION ALL
  SELECT clip, frame, score, i, n, c, gone, win, c >= 12 OR gone >= 25 OR i = n FROM (SELECT f.clip, f.frame, f.score, f.i, f.n, CASE WHEN w.done THEN 1 ELSE w.c + 1 END AS c, CASE WHEN w.done THEN f.shift ELSE w.gone + f.shift END AS gone, CASE WHEN w.done THEN w.win + 1 ELSE w.win END AS win FROM kw w JOIN fr f ON f.clip = w.clip AND f.i = w.i + 1)),
r AS (SELECT clip, frame, score, row_number() OVER (PARTITION BY clip, win ORDER BY score DESC, frame) AS rk FROM kw) SELECT clip, frame, round(score, 6) AS score FROM r WHERE rk = 1"""
)
def key_windows(spark, sf_dir):
    """The sharpest frame of each window that closes after twelve frames or a shift of 25."""
    from trailspark.plans.world import key_frames

    frames = trk(spark, sf_dir).select(F.col("track_id").alias("clip"), F.col("k").alias("frame"), F.col("speed").alias("score"), (F.col("y") / 10).alias("shift"))
    return rounded(key_frames(frames, 12, 25.0).drop("shift"))


@query(f"WITH {TRK}, ks(kf) AS (VALUES (5), (20), (21), (60)), r AS (SELECT track_id, k, kf, row_number() OVER (PARTITION BY track_id, k ORDER BY abs(k - kf), kf) AS rk FROM trk, ks) SELECT track_id, k AS frame, kf AS keyframe FROM r WHERE rk = 1")
def nearest_keyframes(spark, sf_dir):
    from trailspark.plans.world import nearest_keyframe

    return nearest_keyframe(trk(spark, sf_dir).select("track_id", F.col("k").alias("frame")), [60, 5, 21, 20])


@query("WITH r AS (SELECT i, j, 1920 / 3.0 AS w, 1080 / 2.0 AS h FROM range(3) a(i), range(2) b(j)) SELECT greatest(0, round_even(i * w - 0.2 * w / 2, 0))::BIGINT AS x0, greatest(0, round_even(j * h - 0.2 * h / 2, 0))::BIGINT AS y0, least(1920, round_even((i + 1) * w + 0.2 * w / 2, 0))::BIGINT AS x1, least(1080, round_even((j + 1) * h + 0.2 * h / 2, 0))::BIGINT AS y1 FROM r")
def tiles(spark, sf_dir):
    from trailspark.plans.world import tile_grid

    return spark.createDataFrame(tile_grid(1920, 1080, 3, 2, 0.2), "x0 long, y0 long, x1 long, y1 long")


@query(
    f"""WITH {TRK}, s AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, arg_max(x, k) OVER (PARTITION BY track_id) - arg_min(x, k) OVER (PARTITION BY track_id) AS nx, arg_max(y, k) OVER (PARTITION BY track_id) - arg_min(y, k) OVER (PARTITION BY track_id) AS ny FROM trk WINDOW w AS (PARTITION BY track_id ORDER BY k)),
a AS (SELECT track_id, k, atan2(dy, dx) AS h, abs(atan2(dy, dx) - atan2(ny, nx)) AS g, nx * nx + ny * ny > 0 AS far FROM s WHERE dx IS NOT NULL),
f AS (SELECT *, CASE WHEN far AND least(g, 2 * pi() - g) > pi() / 2 THEN h + CASE WHEN h > 0 THEN -pi() ELSE pi() END ELSE h END AS out FROM a)
SELECT track_id, k, round(cos(out), 5) AS cx, round(sin(out), 5) AS cy FROM f"""
)
def flipped_headings(spark, sf_dir):
    """Headings of the steps, turned about where they point away from the track's net motion."""
    df = windows.steps(trk(spark, sf_dir)).where("dx is not null").withColumn("heading", F.atan2("dy", "dx"))
    df = windows.flip_headings(df.drop("dx", "dy", "dt", "step"), trk(spark, sf_dir))
    return df.select("track_id", "k", F.round(F.cos("heading"), 5).alias("cx"), F.round(F.sin("heading"), 5).alias("cy"))


@query(
    f"""WITH RECURSIVE {TRK}, s AS (SELECT track_id, k, x, y, speed < {HIGH} AS st, atan2(y - 50, x - 100) AS h, row_number() OVER (PARTITION BY track_id ORDER BY k) AS i FROM trk),
hl AS (SELECT track_id, i, k, CASE WHEN st THEN h END AS held, x AS ax, y AS ay, h AS out FROM s WHERE i = 1 UNION ALL
  SELECT track_id, i, k, CASE WHEN st THEN held WHEN held IS NULL OR part >= 1 THEN NULL ELSE held END, CASE WHEN st THEN x ELSE ax END, CASE WHEN st THEN y ELSE ay END, CASE WHEN st THEN held WHEN held IS NULL THEN h ELSE held + part * turn END
  FROM (SELECT *, greatest(0, least(1, (sqrt(power(x - ax, 2) + power(y - ay, 2)) / 40 - 0.9) / 1.6)) AS part, (h - held + pi()) - 2 * pi() * floor((h - held + pi()) / (2 * pi())) - pi() AS turn
    FROM (SELECT s.*, l.ax, l.ay, CASE WHEN s.st THEN coalesce(l.held, l.out) ELSE l.held END AS held FROM hl l JOIN s ON s.track_id = l.track_id AND s.i = l.i + 1)))
SELECT track_id, k, round(out, 5) AS heading FROM hl"""
)
def locked_headings(spark, sf_dir):
    """Headings held through stops and blended back over the way after them."""
    df = trk(spark, sf_dir).select("track_id", "k", "x", "y", (F.col("speed") < HIGH).alias("stopped"), F.atan2(F.col("y") - 50, F.col("x") - 100).alias("heading"))
    return rounded(sequences.lock_headings(df, 40.0).select("track_id", "k", "heading"), 5)


@query(f"WITH {TRK}, c AS (SELECT track_id, k, ' ' || track_id || ' ; Car;;' || round(speed, 1) || '; ' AS line FROM trk) SELECT track_id, k, string_split(replace(line, ';;', '; ;'), ';') AS cells, trim(string_split(line, ';')[2]) AS cls, string_split(trim(line), '; ')[1] AS head FROM c")
def split_cells(spark, sf_dir):
    """Delimited text: empty cells kept apart, trimmed and split at a first mark."""
    line = F.concat(F.lit(" "), F.col("track_id").cast("string"), F.lit(" ; Car;;"), F.round("speed", 1).cast("string"), F.lit("; "))
    df = trk(spark, sf_dir).select("track_id", "k", line.alias("line"))
    return df.select("track_id", "k", F.split(F.replace("line", F.lit(";;"), F.lit("; ;")), ";").alias("cells"), F.trim(F.split("line", ";")[1]).alias("cls"), F.split_part(F.trim("line"), F.lit("; "), F.lit(1)).alias("head"))


@query(f"WITH {TRK}, c AS (SELECT track_id, k, (k % 24)::VARCHAR AS h, (k % 60)::VARCHAR AS m, y AS s FROM trk) SELECT track_id, k, CASE WHEN k % 7 = 3 THEN NULL ELSE round((k % 24) * 3600 + (k % 60) * 60 + round(y / 2, 3), 3) END AS seconds FROM c JOIN trk USING (track_id, k)")
def clock_times(spark, sf_dir):
    """Clock strings as seconds; null where the text is no clock time."""
    k = F.col("k")
    text = F.when(k % 7 == 3, F.lit("no time")).otherwise(F.concat_ws(":", (k % 24).cast("string"), (k % 60).cast("string"), F.round(F.col("y") / 2, 3).cast("string")))
    return rounded(trk(spark, sf_dir).select("track_id", "k", g.clock_seconds(text).alias("seconds")), 3)


def united(tracks: DataFrame, manual: DataFrame) -> DataFrame:
    """Samples of detected and hand-made tracks in one table, columns that one side lacks being null."""
    return tracks.unionByName(manual, allowMissingColumns=True)


@query(f"WITH {TRK} SELECT track_id, k, round(x, 6) AS x, round(speed, 6) AS speed, cls FROM trk UNION ALL SELECT -1, i, i * 2.0, NULL, 'manual' FROM range(5) r(i)")
def united_tracks(spark, sf_dir):
    manual = spark.range(5).select(F.lit(-1).cast("long").alias("track_id"), F.col("id").alias("k"), (F.col("id") * 2.0).alias("x"), F.lit("manual").alias("cls"))
    return rounded(united(trk(spark, sf_dir).select("track_id", "k", "x", "speed", "cls"), manual))


@query(
    f"""WITH {STATION}, r0 AS (SELECT track_id, k, s AS x, off AS y FROM sta), a0 AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS sxx, var_pop(y) AS syy, covar_pop(x, y) AS sxy FROM r0),
l0 AS (SELECT r0.*, (y - my) * cos(0.5 * atan2(2 * sxy, sxx - syy)) - (x - mx) * sin(0.5 * atan2(2 * sxy, sxx - syy)) AS l FROM r0, a0), a1 AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS sxx, var_pop(y) AS syy, covar_pop(x, y) AS sxy FROM l0 WHERE abs(l) < 60),
l1 AS (SELECT r0.*, (y - my) * cos(0.5 * atan2(2 * sxy, sxx - syy)) - (x - mx) * sin(0.5 * atan2(2 * sxy, sxx - syy)) AS l FROM r0, a1), a2 AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS sxx, var_pop(y) AS syy, covar_pop(x, y) AS sxy FROM l1 WHERE abs(l) < 60),
l2 AS (SELECT r0.*, (y - my) * cos(0.5 * atan2(2 * sxy, sxx - syy)) - (x - mx) * sin(0.5 * atan2(2 * sxy, sxx - syy)) AS l, (x - mx) * cos(0.5 * atan2(2 * sxy, sxx - syy)) + (y - my) * sin(0.5 * atan2(2 * sxy, sxx - syy)) AS a FROM r0, a2)
SELECT track_id, k, round(l, 5) AS lateral, round(a, 5) AS along, abs(l) < 60 AS kept FROM l2"""
)
def robust_axes(spark, sf_dir):
    """Three rounds of the principal axis, each fitted to the points near the one before."""
    from trailspark.plans.fields import robust_axis

    p = with_station(trk(spark, sf_dir)).select(F.lit("all").alias("g"), "track_id", "k", F.col("s").alias("x"), F.col("off").alias("y"))
    return rounded(robust_axis(p, ["g"], 60.0).select("track_id", "k", "lateral", "along", "kept"), 5)
