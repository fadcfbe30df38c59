"""Space-time fields, fits and grids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailspark.functions.geometry import kmh
from trailspark.operators import graph, kernels, sequences, smoothing, windows
from trailspark.operators.lineage import python_workers, stored
from trailspark.params import Quality
from trailspark.plans import sql
from trailspark.plans.kinematics import STATES, STATION, with_state, with_station
from trailspark.plans.trk import HIGH, LOW, TRK, query, rounded, table, trk

DAY = 86400


def speed_field(samples: DataFrame, dt: float, ds: float, time: str = "t", station: str = "s") -> DataFrame:
    """Mean speed and count of each cell (ti, si) of time by station."""
    return samples.groupBy(F.floor(F.col(time) / dt).alias("ti"), F.floor(F.col(station) / ds).alias("si")).agg(F.avg("speed").alias("speed"), F.count("*").alias("n"))


def theil_sen(points: DataFrame, key: str, t: str = "t", s: str = "s") -> DataFrame:
    """Median of pairwise slopes and the median intercept of each key, many keys at a time; for fits of bounded size (one front, one track), larger ones are an error."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        bounds = smoothing.bounds_of(frame[key]).tolist()
        out = [(frame[key].iloc[a], kernels.theil_sen(frame["t"].iloc[a:b], frame["s"].iloc[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return pd.DataFrame([(k, *fit) for k, fit in out if fit], columns=[key, "slope", "intercept"])

    rows = points.select(key, F.col(t).cast("double").alias("t"), F.col(s).cast("double").alias("s"))
    return smoothing.whole_groups(rows, key, ["t"], run, f"{key} {dict(points.dtypes)[key]}, slope double, intercept double")


def principal_axis(points: DataFrame, key: list[str]) -> DataFrame:
    """Centroid and unit axis of greatest variance, turned towards +x (then +y)."""
    m = points.groupBy(*key).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("sxx"), F.var_pop("y").alias("syy"), F.covar_pop("x", "y").alias("sxy"), F.count("*").alias("n"))
    angle = 0.5 * F.atan2(2 * F.col("sxy"), F.col("sxx") - F.col("syy"))
    turn = F.when((F.cos(angle) < -1e-12) | ((F.abs(F.cos(angle)) <= 1e-12) & (F.sin(angle) < 0)), -1.0).otherwise(1.0)
    return m.select(*key, "mx", "my", (F.cos(angle) * turn).alias("ux"), (F.sin(angle) * turn).alias("uy"), "n")


def robust_axis(points: DataFrame, key: list[str], width: float, rounds: int = 3) -> DataFrame:
    """``points`` with ``lateral`` to the axis of those kept, and ``kept``; the axis is fitted again to the points within ``width``."""
    current = points.withColumn("kept", F.lit(True))
    for _ in range(rounds):
        axis = principal_axis(current.where("kept"), key)
        current = points.join(F.broadcast(axis), key).withColumn("lateral", (F.col("y") - F.col("my")) * F.col("ux") - (F.col("x") - F.col("mx")) * F.col("uy"))
        current = current.withColumn("along", (F.col("x") - F.col("mx")) * F.col("ux") + (F.col("y") - F.col("my")) * F.col("uy")).withColumn("kept", F.abs("lateral") < width)
        current = current.drop("mx", "my", "ux", "uy", "n")
    return current


@query(f"WITH {STATION} SELECT floor(t / {DAY})::BIGINT AS ti, floor(s / 50)::BIGINT AS si, round(avg(speed), 9) AS speed, count(*) AS n FROM sta GROUP BY 1, 2")
def edie_field(spark, sf_dir):
    return rounded(speed_field(with_station(trk(spark, sf_dir)), float(DAY), 50.0), 9)


@query(
    f"""WITH {TRK}, p AS (SELECT track_id, t / {DAY} AS t, x AS s FROM trk),
sl AS (SELECT a.track_id, quantile_cont((b.s - a.s) / (b.t - a.t), 0.5) AS slope FROM p a JOIN p b ON a.track_id = b.track_id AND b.t - a.t > 1e-9 GROUP BY a.track_id)
SELECT track_id, round(any_value(slope), 6) AS slope, round(quantile_cont(s - slope * t, 0.5), 3) AS intercept FROM p JOIN sl USING (track_id) GROUP BY track_id"""
)
def theil_sen_fits(spark, sf_dir):
    p = trk(spark, sf_dir).select("track_id", (F.col("t") / DAY).alias("t"), F.col("x").alias("s"))
    return theil_sen(p, "track_id").select("track_id", F.round("slope", 6).alias("slope"), F.round("intercept", 3).alias("intercept"))


_ANGLE = "0.5 * atan2(2 * sxy, sxx - syy)"


@query(
    f"""WITH {TRK}, m AS (SELECT cls, avg(x) AS mx, avg(y) AS my, var_pop(x) AS sxx, var_pop(y) AS syy, covar_pop(x, y) AS sxy, count(*) AS n FROM trk GROUP BY cls)
SELECT cls, round(mx, 6) AS mx, round(my, 6) AS my, round(cos({_ANGLE}), 6) AS ux, round(sin({_ANGLE}), 6) AS uy, n FROM m"""
)
def pca_axis(spark, sf_dir):
    return rounded(principal_axis(trk(spark, sf_dir), ["cls"]))


@query(
    f"""WITH {STATION}, h AS (SELECT floor(off / 8)::BIGINT AS bin, count(*) AS n FROM sta GROUP BY 1), sp AS (SELECT unnest(range(min(bin), max(bin) + 1)) AS bin FROM h)
SELECT sp.bin, coalesce(n, 0) AS n, round((coalesce(lag(n) OVER w, 0) + 2 * coalesce(n, 0) + coalesce(lead(n) OVER w, 0)) / 4, 6) AS smooth FROM sp LEFT JOIN h USING (bin) WINDOW w AS (ORDER BY sp.bin)"""
)
def histogram_lateral(spark, sf_dir):
    """Offsets in bins of eight, all bins between the first and the last, smoothed by (1, 2, 1). The window is over bins, not rows."""
    h = with_station(trk(spark, sf_dir)).groupBy(F.floor(F.col("off") / 8).alias("bin")).agg(F.count("*").alias("n"))
    spine = h.agg(F.min("bin").alias("a"), F.max("bin").alias("b")).select(F.explode(F.sequence("a", "b")).alias("bin"))
    full = spine.join(h, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.orderBy("bin")
    smooth = (F.coalesce(F.lag("n").over(w), F.lit(0)) + 2 * F.col("n") + F.coalesce(F.lead("n").over(w), F.lit(0))) / 4
    return rounded(full.select("bin", F.col("n").cast("long").alias("n"), smooth.alias("smooth")))


@query("SELECT label, i::INT AS i, round(quantile_cont(v, 0.5), 6) AS med FROM (SELECT label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY label, i")
def array_median(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    return rounded(rows.groupBy("label", "i").agg(F.percentile(F.col("v").cast("double"), F.lit(0.5)).alias("med")))


GRID = f"""{TRK}, st AS (SELECT floor(x / 24)::BIGINT AS cx, floor(y / 24)::BIGINT AS cy, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM trk WINDOW w AS (PARTITION BY track_id ORDER BY k)),
gr AS (SELECT cx, cy, count(*) AS hits, sum(dx) AS dx, sum(dy) AS dy FROM st WHERE dx IS NOT NULL GROUP BY cx, cy)"""


@query(f"WITH {GRID} SELECT cx, cy, hits, round(dx, 4) AS dx, round(dy, 4) AS dy FROM gr")
def flow_grid(spark, sf_dir):
    return rounded(graph.flow_grid(trk(spark, sf_dir), 24.0), 4)


def _components_sql(cells: str, like: str, near: str) -> str:
    return f"""{cells}, pq AS (SELECT a.cx, a.cy, b.cx AS bx, b.cy AS by_ FROM c a JOIN c b ON {near} AND {like}),
re AS (SELECT cx, cy, cx AS rx, cy AS ry FROM c UNION SELECT re.cx, re.cy, pq.bx, pq.by_ FROM re JOIN pq ON pq.cx = re.rx AND pq.cy = re.ry),
ro AS (SELECT cx, cy, min(rx * 1000000 + ry) AS root, count(*) AS size FROM re GROUP BY cx, cy)"""


@query(
    "WITH RECURSIVE "
    + _components_sql(
        f"{GRID}, c AS (SELECT cx, cy, atan2(dy, dx) AS way FROM gr WHERE hits >= 3 AND sqrt(dx * dx + dy * dy) > 1)",
        "least((abs(a.way - b.way)), 2 * pi() - abs(a.way - b.way)) < radians(55)",
        "abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 AND (a.cx <> b.cx OR a.cy <> b.cy)",
    )
    + " SELECT cx, cy, size FROM ro WHERE size >= 3"
)
def road_components(spark, sf_dir):
    grid = graph.flow_grid(trk(spark, sf_dir), 24.0)
    return graph.road_components(grid, 3, 55.0, 3).select("cx", "cy", "size")


SLOW = f"{STATION}, c AS (SELECT floor(t / {DAY})::BIGINT AS cx, floor(s / 50)::BIGINT AS cy FROM sta GROUP BY 1, 2 HAVING avg(speed) < {HIGH})"
_SLOW = _components_sql(SLOW, "true", "abs(a.cx - b.cx) + abs(a.cy - b.cy) = 1")


@query(f"WITH RECURSIVE {_SLOW} SELECT cx, cy, size FROM ro")
def slow_components(spark, sf_dir):
    return graph.grid_components(slow_cells(spark, sf_dir)).select("cx", "cy", "size")


def slow_cells(spark, sf_dir):
    return speed_field(with_station(trk(spark, sf_dir)), float(DAY), 50.0).where(F.col("speed") < HIGH).select(F.col("ti").alias("cx"), F.col("si").alias("cy"))


@query(f"WITH RECURSIVE {_SLOW}, best AS (SELECT root FROM ro GROUP BY root ORDER BY count(*) DESC, root LIMIT 1) SELECT cx, max(cy) AS cy FROM ro WHERE root = (SELECT root FROM best) GROUP BY cx HAVING count(*) >= 1")
def slow_front(spark, sf_dir):
    """The upper edge of the largest slow component."""
    cells = graph.largest_component(graph.grid_components(slow_cells(spark, sf_dir)))
    return graph.component_front(cells, upper=True, min_rows=1)


def wave_fit(events: DataFrame, front: DataFrame, car: float, seed: int = Quality.seed, boots: int = Quality.boots, parts: int = 16) -> DataFrame:
    """One row for each ``wave``: slope, its bootstrap interval, speed in km/h, residual MAD, number of points and whether it is in the band.

    ``events`` and ``front`` have wave, t and s. Events within three car lengths of the
    front's line are fitted; below four of them the front's own slope stands alone. One
    wave's points are one group; its resamples are dealt out to ``parts`` tasks, and of many
    points only slopes near the interval's ends are worked out (all, if the ends aren't among them).
    """
    python_workers(events.sparkSession)
    names = ["wave", "front_slope", "slope", "kmh", "mad", "n", "t", "s"]

    def fit(key: tuple, e: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        row: list = [key[0], None, None, None, None, 0, [], []]
        line = kernels.robust_line(f["t"], f["s"]) if len(f) >= 4 else None
        if len(e) >= 3 and line:
            e = e.sort_values(["t", "s"])
            row[1] = line[0]
            on = e[np.abs(e["s"] - (line[0] * e["t"] + line[1])) < Quality.lateral * car]
            row[5] = len(on)
            if len(on) >= 4 and (own := kernels.robust_line(on["t"], on["s"])):
                left = np.abs(on["s"] - own[0] * on["t"] - own[1])
                row[2:5] = [own[0], abs(own[0]) * Quality.car_m / car * 3.6, float(np.median(left))]
                row[6:] = [on["t"].tolist(), on["s"].tolist()]
        return pd.DataFrame([row], columns=names)

    fits = stored(events.select("wave", "t", "s").groupBy("wave").cogroup(front.select("wave", "t", "s").groupBy("wave")).applyInPandas(fit, "wave string, front_slope double, slope double, kmh double, mad double, n int, t array<double>, s array<double>"))

    def draws(every: bool):
        def run(frames):
            for frame in frames:
                for wave, t, s, slope, part in frame.itertuples(index=False):
                    found, cuts = (kernels.bootstrap_slopes(t, s, boots, seed, part, parts), [-np.inf, np.inf] * 2) if every else kernels.bootstrap_ends(t, s, slope, boots, seed, part, parts)
                    yield pd.DataFrame({"wave": wave, "drawn": found} | dict(zip("abcd", cuts, strict=True)))

        return stored(shares.mapInPandas(run, "wave string, drawn double, a double, b double, c double, d double"))

    shares = fits.where("slope is not null").select("wave", "t", "s", "slope", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).repartition(parts, "wave", "part")
    drawn = draws(False)
    order, last = F.sort_array(F.collect_list("drawn")), F.count("drawn") - 1
    place = lambda share, more: F.get(order, F.least(F.floor(share * last) + more, last).cast("int"))
    between = lambda share, least, most: (place(share, 0) > F.min(least)) & (place(share, 1) < F.max(most))
    if drawn.groupBy("wave").agg((between(0.025, "a", "b") & between(0.975, "c", "d")).alias("sure")).where("not sure").count():
        drawn = draws(True)
    middle = drawn.groupBy("wave").agg(F.percentile("drawn", F.lit(0.025)).alias("low"), F.percentile("drawn", F.lit(0.975)).alias("high"))
    out = fits.drop("t", "s").join(middle, "wave", "left")
    band = F.col("kmh").between(*Quality.band_kmh) & (F.col("low") * F.col("high") > 0)
    return out.select("wave", "front_slope", "slope", "low", "high", "kmh", "mad", "n", F.when(F.col("slope").isNotNull(), F.coalesce(band, F.lit(False))).alias("in_band"))


def axis_of(events: DataFrame, width: float, rounds: int = 3) -> tuple[float, float, float, float] | None:
    """Centre and direction of the events' principal axis, fitted again to those within ``width`` of it; none below three events."""
    kept = events
    axis = None
    for _ in range(rounds):
        row = principal_axis(kept.withColumn("__g", F.lit(0)), ["__g"]).first()
        if row is None or row["n"] < 3:
            return None
        axis = (row["mx"], row["my"], row["ux"], row["uy"])
        kept = events.where(F.abs((F.col("y") - axis[1]) * axis[2] - (F.col("x") - axis[0]) * axis[3]) < width)
    return axis if kept.limit(3).count() >= 3 else None


def waves(samples: DataFrame, events: DataFrame, car: float, v_move: float, cell_s: float = Quality.cell_s, time: str = "t", boots: int = Quality.boots) -> DataFrame:
    """The wave of a clip's stop events (track_id, t, x, y) among its samples, as :func:`wave_fit` and ``backward``; no row without an axis.

    Stations lie along the events' robust axis. Traffic goes the way that most event tracks
    with a net motion of two car lengths go (against the axis if none does); tracks near the
    axis that don't go the other way make the field of mean speeds, whose largest slow
    component's edge is the front.
    """
    axis = axis_of(events, Quality.lateral * car)
    if axis is None:
        return samples.sparkSession.createDataFrame([], "wave string, front_slope double, slope double, low double, high double, kmh double, mad double, n int, in_band boolean, backward boolean")
    mx, my, ux, uy = axis

    def placed(df):
        x, y = F.col("x") - mx, F.col("y") - my
        return df.withColumns({"s": x * ux + y * uy, "lat": y * ux - x * uy})

    rows = placed(samples)
    per = stored(rows.groupBy("track_id").agg(F.percentile(F.abs("lat"), F.lit(0.5)).alias("side"), (F.max_by("s", "k") - F.min_by("s", "k")).alias("net"), F.hypot(F.max_by("x", "k") - F.min_by("x", "k"), F.max_by("y", "k") - F.min_by("y", "k")).alias("far")))
    way = per.join(events.select("track_id").distinct(), "track_id", "left_semi").where(F.col("far") > 2 * car).agg(F.percentile("net", F.lit(0.5)).alias("m")).first()["m"]
    sign = -1 if way is None or way < 0 else 1
    inside = per.where((F.col("side") <= Quality.lateral * car) & (F.col("net") * sign >= 0)).select("track_id")
    field = speed_field(rows.join(inside, "track_id", "left_semi"), cell_s, car, time, "s")
    slow = stored(field.where(F.col("speed") < v_move).select(F.col("ti").alias("cx"), F.col("si").alias("cy")))
    front = graph.component_front(graph.largest_component(graph.grid_components(slow)), upper=sign < 0)
    front = front.select(F.lit("all").alias("wave"), ((F.col("cx") + 0.5) * cell_s).alias("t"), ((F.col("cy") + 0.5) * car).alias("s"))
    near = placed(events).where(F.abs("lat") < Quality.lateral * car).select(F.lit("all").alias("wave"), F.col(time).alias("t"), "s")
    return wave_fit(near, front, car, boots=boots).withColumn("backward", F.col("slope") * sign < 0)


_THEIL = "(SELECT quantile_cont((b.s - a.s) / (b.t - a.t), 0.5) FROM {p} a JOIN {p} b ON b.t - a.t > 1e-9)"


@query(
    f"""WITH RECURSIVE {_SLOW}, best AS (SELECT root FROM ro GROUP BY root ORDER BY count(*) DESC, root LIMIT 1), fp AS (SELECT (cx + 0.5) * {DAY} AS t, max(cy) * 50.0 AS s FROM ro WHERE root = (SELECT root FROM best) GROUP BY cx),
{STATES.replace(TRK + ",", "", 1)}, {sql.onsets('trk', 'runs', 'onset', LOW, 50.0, 3600.0)},
ep AS (SELECT o.track_id, o.t, g.seg, arc + u * sqrt(power(bx - ax, 2) + power(by_ - ay, 2)) AS s, sqrt(power(o.x - ax - u * (bx - ax), 2) + power(o.y - ay - u * (by_ - ay), 2)) AS d FROM (SELECT o.*, g.*, greatest(0, least(1, ((o.x - ax) * (bx - ax) + (o.y - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) AS u FROM onset o, seg g) o, LATERAL (SELECT o.seg AS seg) g),
en AS (SELECT *, row_number() OVER (PARTITION BY track_id, t ORDER BY d, seg) AS rk FROM ep), fl AS (SELECT {_THEIL.format(p='fp')} AS m), fi AS (SELECT m, quantile_cont(s - m * t, 0.5) AS c FROM fp, fl GROUP BY m),
op AS (SELECT t, s FROM en, fi WHERE rk = 1 AND abs(s - (m * t + c)) < 60), ol AS (SELECT {_THEIL.format(p='op')} AS m), oi AS (SELECT m, quantile_cont(s - m * t, 0.5) AS c FROM op, ol GROUP BY m)
SELECT 'all' AS wave, round(fi.m * {DAY}, 6) AS front_slope, round(oi.m * {DAY}, 6) AS slope, (SELECT round(quantile_cont(abs(s - oi.m * t - oi.c), 0.5), 4) FROM op) AS mad, (SELECT count(*) FROM op)::INT AS n FROM fi, oi"""
)
def wave_slopes(spark, sf_dir):
    """The fits of the wave without their interval, a day as the unit of time."""
    front, events = _front_and_events(spark, sf_dir)
    out = wave_fit(events, front, 20.0, boots=0)
    return out.select("wave", F.round(F.col("front_slope") * DAY, 6).alias("front_slope"), F.round(F.col("slope") * DAY, 6).alias("slope"), F.round("mad", 4).alias("mad"), "n")


def _front_and_events(spark, sf_dir):
    front = slow_front(spark, sf_dir).select(F.lit("all").alias("wave"), ((F.col("cx") + 0.5) * DAY).alias("t"), (F.col("cy") * 50.0).alias("s"))
    df = with_state(trk(spark, sf_dir))
    onsets = sequences.stop_onsets(df, sequences.runs(df, "stopped"), LOW, 50.0, 3600.0)
    return front, with_station(onsets).select(F.lit("all").alias("wave"), "t", "s")


@query()
def wave_fits(spark, sf_dir):
    """The wave's fit with the interval of all resamples (no SQL draws numpy's)."""
    front, events = _front_and_events(spark, sf_dir)
    return wave_fit(events, front, 20.0)


@query(f"WITH RECURSIVE {TRK}, zs AS (SELECT track_id, k, (t - min(t) OVER (PARTITION BY track_id)) / {DAY} AS t, x, y, 1.0 AS jac FROM trk), {sql.smoother('zs', 'sm', 50.0)} SELECT track_id, k, round(t, 4) AS t, round(x, 4) AS x, round(y, 4) AS y, round(speed, 4) AS speed FROM sm")
def kalman_smooth(spark, sf_dir):
    df = trk(spark, sf_dir).withColumn("t", (F.col("t") - F.min("t").over(Window.partitionBy("track_id"))) / DAY)
    return rounded(kernels.smooth_tracks(df, 50.0), 4)


@query(f"WITH RECURSIVE {STATES}, {sql.onsets('trk', 'runs', 'onset', LOW, 50.0, 3600.0)}, {sql.wavelets('trk', 'onset', 'wv', 25.0)} SELECT track_id, frame, round(t_wav, 1) AS t_wav FROM onset LEFT JOIN wv USING (track_id, frame)")
def wavelet_onsets(spark, sf_dir):
    df = with_state(trk(spark, sf_dir))
    onsets = sequences.stop_onsets(df, sequences.runs(df, "stopped"), LOW, 50.0, 3600.0)
    return rounded(kernels.wavelet_onsets(df, onsets, 25.0), 1)


_SLIP_FITS = """st AS (SELECT k AS frame, x, y, lead(x) OVER w - x AS vx, lead(y) OVER w - y AS vy FROM trk WINDOW w AS (PARTITION BY track_id ORDER BY k)), sv AS (SELECT * FROM st WHERE vx IS NOT NULL),
pf AS (SELECT DISTINCT frame AS f FROM sv), pa AS (SELECT f, x / 1000 AS x, y / 1000 AS y, vx, vy FROM pf JOIN sv ON abs(sv.frame - pf.f) <= 2), p0 AS (SELECT * FROM pa WHERE f IN (SELECT f FROM pa GROUP BY f HAVING count(*) >= 5)), np AS (SELECT f, count(*) AS n FROM p0 GROUP BY f),
m1 AS (SELECT f, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(vx) AS mu, avg(vy) AS mv, var_pop(x) AS cxx, var_pop(y) AS cyy, covar_pop(x, y) AS cxy, covar_pop(x, vx) AS xu, covar_pop(y, vx) AS yu, covar_pop(x, vy) AS xv, covar_pop(y, vy) AS yv, quantile_cont(vx, 0.5) AS du, quantile_cont(vy, 0.5) AS dv FROM p0 GROUP BY f),
a1 AS (SELECT f, n, n >= 10 AS affine, CASE WHEN n >= 10 THEN (xu * cyy - yu * cxy) / (cxx * cyy - cxy * cxy) ELSE 0 END AS a11, CASE WHEN n >= 10 THEN (yu * cxx - xu * cxy) / (cxx * cyy - cxy * cxy) ELSE 0 END AS a12, CASE WHEN n >= 10 THEN (xv * cyy - yv * cxy) / (cxx * cyy - cxy * cxy) ELSE 0 END AS a21, CASE WHEN n >= 10 THEN (yv * cxx - xv * cxy) / (cxx * cyy - cxy * cxy) ELSE 0 END AS a22, mx, my, mu, mv, du, dv FROM m1),
b1 AS (SELECT *, CASE WHEN affine THEN mu - a11 * mx - a12 * my ELSE du END AS b1, CASE WHEN affine THEN mv - a21 * mx - a22 * my ELSE dv END AS b2 FROM a1),
r1 AS (SELECT p.*, sqrt(power(p.vx - a11 * p.x - a12 * p.y - b1, 2) + power(p.vy - a21 * p.x - a22 * p.y - b2, 2)) AS miss FROM p0 p JOIN b1 USING (f)),
s1 AS (SELECT *, quantile_cont(miss, 0.5) OVER (PARTITION BY f) AS spread FROM r1), k1 AS (SELECT *, miss < greatest(3 * 1.4826 * spread, 1e-6) AS near FROM s1),
c1 AS (SELECT *, count(*) FILTER (near) OVER (PARTITION BY f) AS left_, count(*) OVER (PARTITION BY f) AS all_ FROM k1), t1 AS (SELECT f, x, y, vx, vy FROM c1 WHERE near AND left_ >= 5 AND left_ < all_),
m2 AS (SELECT f, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(vx) AS mu, avg(vy) AS mv, var_pop(x) AS cxx, var_pop(y) AS cyy, covar_pop(x, y) AS cxy, covar_pop(x, vx) AS xu, covar_pop(y, vx) AS yu, covar_pop(x, vy) AS xv, covar_pop(y, vy) AS yv, quantile_cont(vx, 0.5) AS du, quantile_cont(vy, 0.5) AS dv FROM t1 GROUP BY f),
a2 AS (SELECT f, n, n >= 10 AS affine, CASE WHEN n >= 10 THEN (xu * cyy - yu * cxy) / (cxx * cyy - cxy * cxy) ELSE 0 END AS a11, CASE WHEN n >= 10 THEN (yu * cxx - xu * cxy) / (cxx * cyy - cxy * cxy) ELSE 0 END AS a12, CASE WHEN n >= 10 THEN (xv * cyy - yv * cxy) / (cxx * cyy - cxy * cxy) ELSE 0 END AS a21, CASE WHEN n >= 10 THEN (yv * cxx - xv * cxy) / (cxx * cyy - cxy * cxy) ELSE 0 END AS a22, mx, my, mu, mv, du, dv FROM m2),
b2 AS (SELECT *, CASE WHEN affine THEN mu - a11 * mx - a12 * my ELSE du END AS b1, CASE WHEN affine THEN mv - a21 * mx - a22 * my ELSE dv END AS b2 FROM a2),
r2 AS (SELECT p.*, sqrt(power(p.vx - a11 * p.x - a12 * p.y - b1, 2) + power(p.vy - a21 * p.x - a22 * p.y - b2, 2)) AS miss FROM t1 p JOIN b2 USING (f)),
s2 AS (SELECT *, quantile_cont(miss, 0.5) OVER (PARTITION BY f) AS spread FROM r2), k2 AS (SELECT *, miss < greatest(3 * 1.4826 * spread, 1e-6) AS near FROM s2),
c2 AS (SELECT *, count(*) FILTER (near) OVER (PARTITION BY f) AS left_, count(*) OVER (PARTITION BY f) AS all_ FROM k2), t2 AS (SELECT f, x, y, vx, vy FROM c2 WHERE near AND left_ >= 5 AND left_ < all_),
md AS (SELECT f, quantile_cont(vx, 0.5) AS du, quantile_cont(vy, 0.5) AS dv FROM t2 GROUP BY f), s1f AS (SELECT DISTINCT f, spread FROM s1), s2f AS (SELECT DISTINCT f, spread FROM s2)"""


@query(
    f"""WITH {TRK}, {_SLIP_FITS} SELECT b1.f AS frame, round(coalesce(b2.a11, b1.a11), 3) AS a11, round(coalesce(b2.a12, b1.a12), 3) AS a12, round(coalesce(b2.a21, b1.a21), 3) AS a21, round(coalesce(b2.a22, b1.a22), 3) AS a22,
  round(CASE WHEN b2.f IS NULL THEN b1.b1 WHEN NOT b2.affine THEN coalesce(md.du, b2.b1) ELSE b2.b1 END, 4) AS b1, round(CASE WHEN b2.f IS NULL THEN b1.b2 WHEN NOT b2.affine THEN coalesce(md.dv, b2.b2) ELSE b2.b2 END, 4) AS b2, round(coalesce(s2f.spread, s1f.spread), 4) AS spread, np.n
FROM b1 JOIN np USING (f) JOIN s1f USING (f) LEFT JOIN b2 USING (f) LEFT JOIN s2f USING (f) LEFT JOIN md USING (f)"""
)
def slip_field(spark, sf_dir):
    w = windows.along()
    s = trk(spark, sf_dir).select(F.col("k").alias("frame"), "x", "y", (F.lead("x").over(w) - F.col("x")).alias("vx"), (F.lead("y").over(w) - F.col("y")).alias("vy")).where("vx is not null")
    out = kernels.slip_field(s)
    return out.select("frame", *[F.round(c, 3).alias(c) for c in ("a11", "a12", "a21", "a22")], *[F.round(c, 4).alias(c) for c in ("b1", "b2", "spread")], "n")


@query(
    f"""WITH {STATION}, o AS (SELECT *, quantile_cont(abs(off), 0.5) OVER (PARTITION BY track_id) AS lat, first_value(s) OVER w AS s0, last_value(s) OVER w AS s1 FROM sta WINDOW w AS (PARTITION BY track_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT track_id, k, round(s, 6) AS s, round(speed * 4.5 / 20 * 3.6, 5) AS kmh FROM o WHERE lat <= 40 AND s1 - s0 >= 0"""
)
def spacetime(spark, sf_dir):
    """Stations and speeds of the tracks near the line that go its way."""
    df = with_station(trk(spark, sf_dir))
    per = df.groupBy("track_id").agg(F.percentile(F.abs("off"), F.lit(0.5)).alias("lat"), F.min_by("s", "k").alias("s0"), F.max_by("s", "k").alias("s1")).where("lat <= 40 and s1 - s0 >= 0")
    return df.join(per.select("track_id"), "track_id", "left_semi").select("track_id", "k", F.round("s", 6).alias("s"), F.round(kmh(F.col("speed"), 20.0), 5).alias("kmh"))


@query(
    f"""WITH {TRK}, e AS (SELECT track_id, count(*) AS n FROM trk WHERE cls = 'purchase' GROUP BY 1), l AS (SELECT track_id, max(t) - min(t) AS life FROM trk GROUP BY 1)
SELECT track_id, round(life, 3) AS life, n FROM l JOIN e USING (track_id) ORDER BY life DESC, track_id LIMIT 10"""
)
def longest_tracks(spark, sf_dir):
    """The ten longest tracks that have events: a top-k report."""
    df = trk(spark, sf_dir)
    e = df.where("cls = 'purchase'").groupBy("track_id").agg(F.count("*").alias("n"))
    life = df.groupBy("track_id").agg((F.max("t") - F.min("t")).alias("life"))
    return rounded(life.join(e, "track_id").orderBy(F.desc("life"), "track_id").limit(10).select("track_id", "life", "n"), 3)


@query(f"WITH {TRK}, r AS (SELECT *, row_number() OVER (PARTITION BY floor(t / {DAY}) ORDER BY speed DESC, track_id, k) AS rk FROM trk) SELECT floor(t / {DAY})::BIGINT AS day, track_id, k, round(speed, 6) AS speed FROM r WHERE rk <= 5")
def top_per_frame(spark, sf_dir):
    """The five fastest samples of each day, by a bounded sort of each group (as the cap on detections per frame)."""
    df = trk(spark, sf_dir).withColumn("day", F.floor(F.col("t") / DAY))
    w = Window.partitionBy("day").orderBy(F.desc("speed"), "track_id", "k")
    return rounded(df.withColumn("rk", F.row_number().over(w)).where("rk <= 5").select("day", "track_id", "k", "speed"))
