"""Path, state and geometry queries over the trajectory view."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailspark.functions import geometry as g
from trailspark.operators import joins, sequences, windows
from trailspark.plans import sql
from trailspark.plans.trk import HIGH, LOW, TRK, query, rounded, trk

STATES = f"""{TRK},
st AS (SELECT *, coalesce(last_value(CASE WHEN speed < {LOW} THEN true WHEN speed > {HIGH} THEN false END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY k), false) AS stopped FROM trk),
ch AS (SELECT *, CASE WHEN lag(stopped) OVER (PARTITION BY track_id ORDER BY k) = stopped THEN 0 ELSE 1 END AS c FROM st),
rn AS (SELECT *, sum(c) OVER (PARTITION BY track_id ORDER BY k) - 1 AS run_no FROM ch),
runs AS (SELECT track_id, run_no::BIGINT AS run_no, any_value(stopped) AS stopped, min(k) AS f0, max(k) AS f1, min(t) AS t0, max(t) AS t1, count(*) AS n FROM rn GROUP BY track_id, run_no)"""

STEPS = f"""{TRK},
s AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, t - lag(t) OVER w AS dt, (speed + lag(speed) OVER w) / 2 AS vm,
  first_value(x) OVER w AS x0, first_value(y) OVER w AS y0 FROM trk WINDOW w AS (PARTITION BY track_id ORDER BY k)),
p AS (SELECT track_id, count(*) AS n, min(t) AS t0, max(t) AS t1, coalesce(sum(sqrt(dx * dx + dy * dy)), 0) AS path,
  sqrt(power(arg_max(x, k) - arg_min(x, k), 2) + power(arg_max(y, k) - arg_min(y, k), 2)) AS net,
  max(sqrt(power(x - x0, 2) + power(y - y0, 2))) AS reach, coalesce(sum(vm * dt), 0) AS integral FROM s GROUP BY track_id)"""


def with_state(df):
    return df.withColumn("stopped", sequences.hysteresis("speed", LOW, HIGH))


@query(f"WITH {STATES} SELECT * FROM runs")
def state_runs(spark, sf_dir):
    return sequences.runs(with_state(trk(spark, sf_dir)), "stopped").withColumn("run_no", F.col("run_no").cast("long"))


@query(f"WITH RECURSIVE {STATES}, {sql.absorbed('st', 'ab', 3)} SELECT * FROM ab")
def absorbed_runs(spark, sf_dir):
    return sequences.state_runs(with_state(trk(spark, sf_dir)), "stopped", 3)


@query(f"WITH {STEPS} SELECT track_id, n, round(t0, 6) AS t0, round(t1, 6) AS t1, round(path, 6) AS path, round(net, 6) AS net, round(reach, 6) AS reach, round(integral, 3) AS integral FROM p")
def path_stats(spark, sf_dir):
    return rounded(windows.path_stats(trk(spark, sf_dir))).withColumn("integral", F.round("integral", 3))


@query(f"WITH {STEPS} SELECT track_id, n, round(net, 6) AS net FROM p WHERE t1 - t0 >= 3 AND net < 60 AND path < 9000")
def static_tracks(spark, sf_dir):
    p = windows.path_stats(trk(spark, sf_dir))
    return rounded(p.where("t1 - t0 >= 3 and net < 60 and path < 9000").select("track_id", "n", "net"))


@query(f"WITH {STEPS} SELECT track_id, round(abs(integral / 86400 - path) / path, 6) AS drift FROM p WHERE n >= 10 AND path >= 100")
def integral_drift(spark, sf_dir):
    p = windows.path_stats(trk(spark, sf_dir)).where("n >= 10 and path >= 100")
    return rounded(p.select("track_id", (F.abs(F.col("integral") / 86400 - F.col("path")) / F.col("path")).alias("drift")))


_GRAD = """CASE WHEN {v}0 IS NOT NULL AND {v}1 IS NOT NULL THEN ((t - t0) * (t - t0) * {v}1 + ((t1 - t) * (t1 - t) - (t - t0) * (t - t0)) * {v} - (t1 - t) * (t1 - t) * {v}0) / ((t - t0) * (t1 - t) * (t1 - t0))
  WHEN {v}1 IS NOT NULL THEN ({v}1 - {v}) / (t1 - t) ELSE ({v} - {v}0) / (t - t0) END"""


@query(
    f"""WITH {TRK},
a AS (SELECT *, lag(speed) OVER w AS speed0, lead(speed) OVER w AS speed1, lag(t) OVER w AS t0, lead(t) OVER w AS t1 FROM trk WINDOW w AS (PARTITION BY track_id ORDER BY k)),
b AS (SELECT track_id, k, t, t0, t1, {_GRAD.format(v="speed")} AS acc FROM a),
c AS (SELECT *, lag(acc) OVER w AS acc0, lead(acc) OVER w AS acc1 FROM b WINDOW w AS (PARTITION BY track_id ORDER BY k)),
d AS (SELECT {_GRAD.format(v="acc")} AS jerk FROM c)
SELECT count(*) AS n, count(*) FILTER (abs(jerk) > 1e-6) AS n_over, round(avg(CASE WHEN abs(jerk) > 1e-6 THEN 1.0 ELSE 0.0 END), 6) AS share FROM d"""
)
def jerk_share(spark, sf_dir):
    df = trk(spark, sf_dir).withColumn("acc", windows.gradient("speed"))
    df = df.withColumn("jerk", windows.gradient("acc"))
    over = F.abs("jerk") > 1e-6
    return df.agg(F.count("*").alias("n"), F.count(F.when(over, 1)).alias("n_over"), F.round(F.avg(F.when(over, 1.0).otherwise(0.0)), 6).alias("share"))


@query(f"WITH {STATES} SELECT track_id, run_no::BIGINT AS run_no, count(*) AS n, round(quantile_cont(speed, 0.5), 6) AS median_speed FROM rn WHERE stopped GROUP BY track_id, run_no HAVING count(*) >= 2")
def stopped_speeds(spark, sf_dir):
    df = with_state(trk(spark, sf_dir))
    r = sequences.runs(df, "stopped").where("stopped").select(F.col("track_id").alias("id"), "run_no", "f0", "f1")
    hit = df.join(r, (F.col("track_id") == F.col("id")) & F.col("k").between(F.col("f0"), F.col("f1")))
    out = hit.groupBy("track_id", F.col("run_no").cast("long").alias("run_no")).agg(F.count("*").alias("n"), F.percentile("speed", F.lit(0.5)).alias("median_speed"))
    return rounded(out.where("n >= 2"))


@query(
    f"""WITH {TRK}, m AS (SELECT cls, quantile_cont(speed, 0.5) AS med FROM trk GROUP BY cls)
SELECT cls, round(quantile_cont(speed, 0.1), 6) AS p10, round(quantile_cont(speed, 0.5), 6) AS p50, round(quantile_cont(speed, 0.9), 6) AS p90, round(quantile_cont(speed, 0.975), 6) AS p975,
  round(1.4826 * quantile_cont(abs(speed - med), 0.5), 6) AS mad FROM trk JOIN m USING (cls) GROUP BY cls"""
)
def speed_percentiles(spark, sf_dir):
    df = trk(spark, sf_dir)
    med = df.groupBy("cls").agg(F.percentile("speed", F.lit(0.5)).alias("med"))
    ps = [F.percentile("speed", F.lit(p)).alias(n) for p, n in ((0.1, "p10"), (0.5, "p50"), (0.9, "p90"), (0.975, "p975"))]
    out = df.join(F.broadcast(med), "cls").groupBy("cls").agg(*ps, (1.4826 * F.percentile(F.abs(F.col("speed") - F.col("med")), F.lit(0.5))).alias("mad"))
    return rounded(out)


H = (1.1, 0.02, 5.0, -0.01, 0.95, 3.0, 1e-4, -2e-4, 1.0)
_W = f"({H[6]} * x + {H[7]} * y + {H[8]})"
_P = f"({H[0]} * x + {H[1]} * y + {H[2]}) / {_W}", f"({H[3]} * x + {H[4]} * y + {H[5]}) / {_W}"


def _sql_project(x: str, y: str) -> tuple[str, str]:
    w = f"({H[6]} * ({x}) + {H[7]} * ({y}) + {H[8]})"
    return f"(({H[0]} * ({x}) + {H[1]} * ({y}) + {H[2]}) / {w})", f"(({H[3]} * ({x}) + {H[4]} * ({y}) + {H[5]}) / {w})"


@query(f"WITH {TRK} SELECT track_id, k, round({_sql_project('x', 'y')[0]}, 6) AS wx, round({_sql_project('x', 'y')[1]}, 6) AS wy, round(x, 6) AS bx, round(y, 6) AS by_ FROM trk")
def homography_map(spark, sf_dir):
    """There and back by the inverse matrix."""
    df = trk(spark, sf_dir)
    wx, wy = g.project(H, F.col("x"), F.col("y"))
    df = df.select("track_id", "k", wx.alias("wx"), wy.alias("wy"))
    bx, by = g.project(g.inverse(H), F.col("wx"), F.col("wy"))
    return rounded(df.select("track_id", "k", "wx", "wy", bx.alias("bx"), by.alias("by_")))


def _jac(kind: str) -> str:
    x0, y0 = _sql_project("x", "y")
    x1, y1 = _sql_project("x + 2", "y")
    x2, y2 = _sql_project("x", "y + 2")
    if kind == "mean":
        return f"(sqrt(power({x1} - {x0}, 2) + power({y1} - {y0}, 2)) + sqrt(power({x2} - {x0}, 2) + power({y2} - {y0}, 2))) / 4"
    return f"sqrt(abs(({x1} - {x0}) * ({y2} - {y0}) - ({x2} - {x0}) * ({y1} - {y0}))) / 2"


@query(f"WITH {TRK} SELECT track_id, k, round({_jac('mean')}, 6) AS scale, round({_jac('area')}, 6) AS area FROM trk")
def jacobian_scale(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    return rounded(trk(spark, sf_dir).select("track_id", "k", g.jacobian_scale(H, x, y).alias("scale"), g.area_scale(H, x, y).alias("area")))


LINE, TOWARDS = (150.0, 0.0, 150.0, 100.0), (1.0, 0.0)


@query(
    f"""WITH {TRK}, s AS (SELECT track_id, k, t, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(t) OVER w AS pt FROM trk WINDOW w AS (PARTITION BY track_id ORDER BY k))
SELECT track_id, k, round(pt + (150 - px) / (x - px) * (t - pt), 1) AS t FROM s
WHERE px < 150 AND x >= 150 AND (py + (150 - px) / (x - px) * (y - py)) / 100 BETWEEN -0.15 AND 1.15"""
)
def line_crossings(spark, sf_dir):
    w = windows.along()
    df = trk(spark, sf_dir).withColumns({f"p{c}": F.lag(c).over(w) for c in ("x", "y", "t")})
    hit, part = g.crossing(F.col("px"), F.col("py"), F.col("x"), F.col("y"), LINE, TOWARDS)
    return rounded(df.where(hit).select("track_id", "k", (F.col("pt") + part * (F.col("t") - F.col("pt"))).alias("t")), 1)


_CROSSED = """cr AS (SELECT track_id, k, round(pt + (150 - px) / (x - px) * (t - pt), 1) AS t FROM (SELECT track_id, k, t, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(t) OVER w AS pt FROM trk WINDOW w AS (PARTITION BY track_id ORDER BY k))
WHERE px < 150 AND x >= 150 AND (py + (150 - px) / (x - px) * (y - py)) / 100 BETWEEN -0.15 AND 1.15)"""


@query(f"WITH RECURSIVE {TRK}, {_CROSSED}, {sql.refractory('cr', 'ok', 4 * 86400.0)} SELECT * FROM ok")
def accepted_crossings(spark, sf_dir):
    """Crossings at least four days after the last accepted one."""
    return sequences.refractory(line_crossings(spark, sf_dir), ["track_id"], "t", 4 * 86400.0)


POLYGON = [(40.0, 10.0), (300.0, 5.0), (420.0, 60.0), (200.0, 95.0), (120.0, 50.0)]


def _pip_sql() -> str:
    parts = []
    for i, (x1, y1) in enumerate(POLYGON):
        x0, y0 = POLYGON[i - 1]
        parts.append(f"CASE WHEN (y > {y0}) <> (y > {y1}) AND x < ({x1} - {x0}) * (y - {y0}) / ({y1} - {y0}) + {x0} THEN 1 ELSE 0 END")
    return f"(({' + '.join(parts)}) % 2 = 1)"


@query(f"WITH {TRK} SELECT track_id, k, {_pip_sql()} AS inside, {_pip_sql()} AS inside_array FROM trk")
def point_in_polygon(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    poly = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in POLYGON])
    return trk(spark, sf_dir).select("track_id", "k", g.in_polygon(x, y, POLYGON).alias("inside"), g.in_polygon_array(x, y, poly).alias("inside_array"))


POLYLINE = [(0.0, 0.0), (150.0, 40.0), (260.0, 35.0), (500.0, 90.0)]
_SEGS = ", ".join(f"({s}, {ax}, {ay}, {bx}, {by}, {arc!r})" for s, ax, ay, bx, by, arc in joins.segments_of(POLYLINE))
STATION = f"""{TRK}, seg(seg, ax, ay, bx, by_, arc) AS (VALUES {_SEGS}),
pr AS (SELECT track_id, k, t, speed, x, y, seg, ax, ay, bx, by_, arc, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) AS u FROM trk, seg),
ds AS (SELECT *, sqrt(power(x - ax - u * (bx - ax), 2) + power(y - ay - u * (by_ - ay), 2)) AS d FROM pr),
ne AS (SELECT *, row_number() OVER (PARTITION BY track_id, k ORDER BY d, seg) AS rk FROM ds),
sta AS (SELECT track_id, k, t, speed, seg, d, arc + u * sqrt(power(bx - ax, 2) + power(by_ - ay, 2)) AS s, CASE WHEN (bx - ax) * (y - ay) - (by_ - ay) * (x - ax) < 0 THEN -d ELSE d END AS off FROM ne WHERE rk = 1)"""


def with_station(df):
    return df.withColumn("p", joins.station(F.col("x"), F.col("y"), POLYLINE)).select(*df.columns, "p.*")


@query(f"WITH {STATION} SELECT track_id, k, seg, round(d, 6) AS d, round(s, 6) AS s, round(off, 6) AS off FROM sta")
def polyline_station(spark, sf_dir):
    return rounded(with_station(trk(spark, sf_dir)).select("track_id", "k", "seg", "d", "s", "off"))


@query(f"WITH {STATION} SELECT track_id, k, seg, round(d, 6) AS d, round(s, 6) AS s, round(off, 6) AS off FROM sta")
def station_by_join(spark, sf_dir):
    """The same with the segments in a table, for lines that come with the data."""
    rows = [("a", s, ax, ay, bx, by, arc) for s, ax, ay, bx, by, arc in joins.segments_of(POLYLINE)]
    seg = spark.createDataFrame(rows, "line_id string, seg int, ax double, ay double, bx double, by double, arc0 double")
    found = joins.nearest_segment(trk(spark, sf_dir).withColumn("line_id", F.lit("a")), seg, ["track_id", "k"])
    return rounded(found.select("track_id", "k", "seg", "d", "s", "off"))


_VERT = ", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(POLYLINE))


@query(
    f"""WITH {TRK}, v(v, vx, vy) AS (VALUES {_VERT}), r AS (SELECT track_id, k, v, sqrt(power(x - vx, 2) + power(y - vy, 2)) AS d FROM trk, v),
n AS (SELECT *, row_number() OVER (PARTITION BY track_id, k ORDER BY d, v) AS rk FROM r) SELECT track_id, k, v, round(d, 6) AS d FROM n WHERE rk = 1"""
)
def nearest_vertex(spark, sf_dir):
    p = joins.nearest_vertex(F.col("x"), F.col("y"), POLYLINE)
    return rounded(trk(spark, sf_dir).withColumn("p", p).select("track_id", "k", "p.v", "p.d"))


_TURN = "degrees(atan2(1.0 * ny - 0.2 * nx, 1.0 * nx + 0.2 * ny))"


@query(
    f"""WITH {TRK}, n AS (SELECT track_id, arg_max(x, k) - arg_min(x, k) AS nx, arg_max(y, k) - arg_min(y, k) AS ny FROM trk GROUP BY track_id)
SELECT track_id, round({_TURN}, 6) AS turn, CASE WHEN abs({_TURN}) <= 45 THEN 'straight' WHEN abs({_TURN}) >= 135 THEN 'uturn' WHEN {_TURN} > 0 THEN 'right' ELSE 'left' END AS movement FROM n"""
)
def movement_label(spark, sf_dir):
    n = trk(spark, sf_dir).groupBy("track_id").agg(F.max_by(F.struct("x", "y"), "k").alias("b"), F.min_by(F.struct("x", "y"), "k").alias("a"))
    turn = g.turn_degrees(1.0, 0.2, F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y"))
    return n.select("track_id", F.round(turn, 6).alias("turn"), g.movement(turn).alias("movement"))


@query(
    f"""WITH {TRK}, g AS (SELECT track_id, k, 50 + y / 1000 AS lat, 14 + x / 1000 AS lon FROM trk),
m AS (SELECT avg(la) AS lat0, avg(lo) AS lon0 FROM (SELECT avg(lat) AS la, avg(lon) AS lo FROM g GROUP BY track_id))
SELECT track_id, k, round((lon - lon0) * 111320 * cos(radians(lat0)), 4) AS x, round((lat - lat0) * 111320, 4) AS y FROM g, m"""
)
def geo_to_local(spark, sf_dir):
    from trailspark.sources.trajectories import to_local

    df = trk(spark, sf_dir).select("track_id", "k", (50 + F.col("y") / 1000).alias("lat"), (14 + F.col("x") / 1000).alias("lon"))
    return rounded(to_local(df).select("track_id", "k", "x", "y"), 4)


@query(
    f"""WITH {TRK}, c AS (SELECT track_id, k, greatest(0, least(1, (speed - {LOW}) / 80)) AS p FROM trk)
SELECT track_id, k, CASE WHEN p < 0.5 THEN 255 ELSE round(255 * (2 - 2 * p))::INT END AS r, CASE WHEN p < 0.5 THEN round(255 * 2 * p)::INT ELSE 255 END AS g, 0 AS b FROM c"""
)
def speed_colours(spark, sf_dir):
    return trk(spark, sf_dir).withColumn("c", g.speed_colour(F.col("speed"), LOW, LOW + 80)).select("track_id", "k", "c.*")


@query(
    f"""WITH {TRK}, s AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM trk WINDOW w AS (PARTITION BY track_id ORDER BY k))
SELECT track_id, k, round(sum(coalesce(sqrt(dx * dx + dy * dy), 0)) OVER (PARTITION BY track_id ORDER BY k), 6) AS arc FROM s"""
)
def cumulative_arc(spark, sf_dir):
    return rounded(windows.cumulative_arc(trk(spark, sf_dir)).select("track_id", "k", "arc"))


@query(
    f"""WITH {STEPS}, arcs AS (SELECT track_id, k, x, y, sum(coalesce(sqrt(dx * dx + dy * dy), 0)) OVER (PARTITION BY track_id ORDER BY k) AS arc FROM s),
z AS (SELECT *, lead(arc) OVER w AS arc1, lead(x) OVER w AS x1, lead(y) OVER w AS y1, max(arc) OVER (PARTITION BY track_id) AS total FROM arcs WINDOW w AS (PARTITION BY track_id ORDER BY k)),
q AS (SELECT track_id, k, i, total * i / 19 AS s, arc, arc1, x, y, x1, y1, total FROM z, range(20) r(i) WHERE arc1 > arc),
h AS (SELECT track_id, i, s, k, CASE WHEN i = 19 THEN 1.0 ELSE (s - arc) / (arc1 - arc) END AS u, x, y, x1, y1 FROM q WHERE (s >= arc AND s < arc1) OR (i = 19 AND arc1 = total)),
f AS (SELECT *, row_number() OVER (PARTITION BY track_id, i ORDER BY k) AS rk FROM h)
SELECT track_id, i::INT AS i, round(s, 5) AS s, round(x + u * (x1 - x), 5) AS x, round(y + u * (y1 - y), 5) AS y FROM f WHERE rk = 1"""
)
def resample_arc(spark, sf_dir):
    return rounded(windows.resample_arc(trk(spark, sf_dir), 20), 5)


@query(
    f"""WITH {TRK} SELECT track_id, k, round(quantile_cont(speed, 0.5) OVER (PARTITION BY track_id ORDER BY t RANGE BETWEEN 172800 PRECEDING AND 172800 FOLLOWING), 6) AS med FROM trk"""
)
def rolling_median(spark, sf_dir):
    return rounded(trk(spark, sf_dir).select("track_id", "k", windows.rolling_median("speed", 172800.0).alias("med")))


@query(
    f"""WITH {TRK}, m AS (SELECT *, quantile_cont(speed, 0.5) OVER (PARTITION BY track_id ORDER BY t RANGE BETWEEN 172800 PRECEDING AND 172800 FOLLOWING) AS med, count(*) OVER (PARTITION BY track_id) AS n FROM trk)
SELECT track_id, k, round(CASE WHEN n >= 5 THEN greatest(med - 30, least(med + 30, speed)) ELSE speed END, 6) AS clipped FROM m"""
)
def spike_clip(spark, sf_dir):
    out = windows.clip_spikes(trk(spark, sf_dir), "speed", 172800.0, 30.0)
    return rounded(out.select("track_id", "k", F.col("speed_clipped").alias("clipped")))


@query(
    f"""WITH {TRK}, n AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY track_id) AS n,
  sum(speed) OVER (PARTITION BY track_id ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s5, count(*) OVER (PARTITION BY track_id ORDER BY k ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS c7,
  avg(speed) OVER (PARTITION BY track_id ORDER BY k ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS a7,
  first_value(speed) OVER (PARTITION BY track_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v0, last_value(speed) OVER (PARTITION BY track_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v1 FROM trk)
SELECT track_id, k, round((s5 + greatest(0, 2 - i) * v0 + greatest(0, 2 - (n - 1 - i)) * v1) / 5, 6) AS padded, round(CASE WHEN c7 = 7 THEN a7 ELSE speed END, 6) AS box FROM n"""
)
def moving_averages(spark, sf_dir):
    return rounded(trk(spark, sf_dir).select("track_id", "k", windows.moving_average("speed", 5).alias("padded"), windows.box_filter("speed").alias("box")))


_SG = " + ".join(f"{w} * {'lag' if o < 0 else 'lead'}(speed, {abs(o)}) OVER w" for o, w in ((-3, -2), (-2, 3), (-1, 6), (1, 6), (2, 3), (3, -2)))


@query(f"WITH {TRK}, z AS (SELECT track_id, k, ({_SG} + 7 * speed) / 21 AS v FROM trk WINDOW w AS (PARTITION BY track_id ORDER BY k)) SELECT track_id, k, round(v, 6) AS v FROM z")
def savgol_interior(spark, sf_dir):
    return rounded(trk(spark, sf_dir).select("track_id", "k", windows.savgol_interior("speed").alias("v")))


@query(
    f"""WITH {TRK}, d AS (SELECT track_id, floor(t / 86400)::BIGINT AS frame, avg(speed) AS speed FROM trk GROUP BY 1, 2),
sp AS (SELECT track_id, unnest(range(min(frame), max(frame) + 1)) AS frame FROM d GROUP BY track_id),
j AS (SELECT sp.track_id, sp.frame, d.speed, d.frame AS here FROM sp LEFT JOIN d ON d.track_id = sp.track_id AND d.frame = sp.frame),
w AS (SELECT *, last_value(here IGNORE NULLS) OVER a AS f0, first_value(here IGNORE NULLS) OVER b AS f1, last_value(speed IGNORE NULLS) OVER a AS v0, first_value(speed IGNORE NULLS) OVER b AS v1 FROM j
  WINDOW a AS (PARTITION BY track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY track_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT track_id, frame, round(CASE WHEN f1 - f0 > 2 THEN NULL WHEN f0 = f1 THEN speed ELSE v0 + (v1 - v0) * (frame - f0) / (f1 - f0) END, 6) AS speed, here IS NULL AS filled FROM w"""
)
def gap_fill(spark, sf_dir):
    """One row a day; gaps of more than two days stay empty."""
    days = trk(spark, sf_dir).groupBy("track_id", F.floor(F.col("t") / 86400).alias("frame")).agg(F.avg("speed").alias("speed"))
    return rounded(windows.gap_fill(days, ["speed"], max_gap=2))


@query(
    f"""WITH {STEPS}, a AS (SELECT track_id, k, CASE WHEN speed >= 40 AND dx * dx + dy * dy > 0 THEN atan2(dy, dx) END AS way FROM s)
SELECT track_id, k, round(last_value(way IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY k), 6) AS heading FROM a"""
)
def heading_held(spark, sf_dir):
    return rounded(windows.heading_held(trk(spark, sf_dir), 40.0).select("track_id", "k", "heading"))


@query(
    f"""WITH {STEPS}, a AS (SELECT track_id, k, atan2(dy, dx) AS way FROM s WHERE dx * dx + dy * dy > 0),
b AS (SELECT track_id, abs(way - lag(way) OVER (PARTITION BY track_id ORDER BY k)) AS d FROM a)
SELECT track_id, round(coalesce(sum(least(d, 2 * pi() - d)), 0), 5) AS turn FROM b GROUP BY track_id"""
)
def total_turn(spark, sf_dir):
    return rounded(windows.total_turn(trk(spark, sf_dir)), 5)


@query(
    f"""WITH {STATES}, pv AS (SELECT *, lag(f0) OVER w AS p0, lag(f1) OVER w AS p1 FROM runs WINDOW w AS (PARTITION BY track_id ORDER BY run_no)),
c AS (SELECT * FROM pv WHERE stopped AND p0 IS NOT NULL),
s AS (SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS step, lag(t) OVER w AS pt, lag(speed) OVER w AS pv FROM trk WINDOW w AS (PARTITION BY track_id ORDER BY k)),
o AS (SELECT c.track_id, c.run_no, c.f0, sum(CASE WHEN s.k <= c.p1 AND s.k > c.p0 THEN step END) AS path, max(CASE WHEN s.k <= c.p1 THEN s.t END) - min(s.t) AS seconds,
  max(CASE WHEN s.k = c.f0 THEN s.t END) AS t, max(CASE WHEN s.k = c.f0 THEN s.speed END) AS v, max(CASE WHEN s.k = c.f0 THEN s.pt END) AS pt, max(CASE WHEN s.k = c.f0 THEN s.pv END) AS pv, max(CASE WHEN s.k = c.f0 THEN s.x END) AS x, max(CASE WHEN s.k = c.f0 THEN s.y END) AS y
  FROM c JOIN s ON s.track_id = c.track_id AND s.k BETWEEN c.p0 AND c.f0 GROUP BY c.track_id, c.run_no, c.f0)
SELECT track_id, f0 AS frame, round(CASE WHEN pv > {LOW} AND v < {LOW} THEN pt + (pv - {LOW}) / (pv - v) * (t - pt) ELSE t END, 1) AS t, round(x, 6) AS x, round(y, 6) AS y FROM o WHERE path >= 50 AND seconds >= 3600"""
)
def stop_onsets(spark, sf_dir):
    df = with_state(trk(spark, sf_dir))
    out = sequences.stop_onsets(df, sequences.runs(df, "stopped"), LOW, 50.0, 3600.0)
    return rounded(out).withColumn("t", F.round("t", 1))


@query(f"WITH RECURSIVE {TRK}, {sql.three_states('trk', 'q3', LOW, HIGH, 2)} SELECT * FROM q3")
def three_states(spark, sf_dir):
    return sequences.three_states(trk(spark, sf_dir), LOW, HIGH, 2).select("track_id", "k", "state")


@query(f"WITH RECURSIVE {TRK}, fr AS (SELECT track_id, k AS frame, x, y FROM trk), {sql.screened('fr', 'kept', 150.0)} SELECT * FROM kept")
def jump_screen(spark, sf_dir):
    df = trk(spark, sf_dir).withColumnRenamed("k", "frame")
    return sequences.screen_jumps(df, 150.0).select("track_id", "frame", "x", "y")


SIMPLE = f"CASE WHEN speed < {LOW} THEN 'stopped' WHEN speed < {HIGH} THEN 'braking' ELSE 'rolling' END"


def simple_states(df):
    return df.withColumn("state", F.when(F.col("speed") < LOW, "stopped").when(F.col("speed") < HIGH, "braking").otherwise("rolling"))


@query(
    f"""WITH {TRK}, s AS (SELECT track_id, k, {SIMPLE} AS state FROM trk), c AS (SELECT *, lag(state) OVER w AS b FROM s WINDOW w AS (PARTITION BY track_id ORDER BY k))
SELECT track_id, k FROM c WHERE state = 'stopped' AND b <> 'stopped'"""
)
def stop_commits(spark, sf_dir):
    return sequences.stop_commits(simple_states(trk(spark, sf_dir))).select("track_id", "k")


@query(
    f"""WITH {TRK}, s AS (SELECT track_id, k, {SIMPLE} AS state FROM trk),
c AS (SELECT *, lag(state) OVER w AS b, sum(CASE WHEN state = 'rolling' THEN 1 ELSE 0 END) OVER w AS r FROM s WINDOW w AS (PARTITION BY track_id ORDER BY k)),
m AS (SELECT track_id, k, r, lag(r) OVER (PARTITION BY track_id ORDER BY k) AS pr FROM c WHERE state = 'stopped' AND b <> 'stopped')
SELECT track_id, k FROM m WHERE r > coalesce(pr, 0)"""
)
def onset_flips(spark, sf_dir):
    return sequences.rearmed_commits(simple_states(trk(spark, sf_dir))).select("track_id", "k")


@query(
    f"""WITH {TRK}, s AS (SELECT track_id, k, {SIMPLE} AS state FROM trk),
o AS (SELECT DISTINCT track_id, f AS frame, st FROM s, (VALUES (10, 'stopped'), (12, 'rolling'), (30, 'braking')) v(f, st)),
c AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY track_id ORDER BY k) = state THEN NULL ELSE k END AS ch FROM s),
g AS (SELECT *, max(ch) OVER (PARTITION BY track_id ORDER BY k) AS seg FROM c),
p AS (SELECT o.track_id, o.frame, o.st, min(g.k) AS a, arg_min(g.seg, g.k) AS pseg FROM o JOIN g ON g.track_id = o.track_id AND g.k >= o.frame GROUP BY 1, 2, 3)
SELECT g.track_id, g.k, coalesce(arg_max(p.st, p.frame), any_value(g.state)) AS state FROM g LEFT JOIN p ON p.track_id = g.track_id AND p.pseg = g.seg AND g.k >= p.a GROUP BY g.track_id, g.k"""
)
def override_apply(spark, sf_dir):
    s = simple_states(trk(spark, sf_dir)).select("track_id", "k", "state")
    pins = spark.createDataFrame([(10, "stopped"), (12, "rolling"), (30, "braking")], "frame long, state string")
    o = s.select("track_id").distinct().crossJoin(F.broadcast(pins))
    return sequences.pin_overrides(s, o)
