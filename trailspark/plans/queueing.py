"""Queues at approaches: arrivals, departures, queue lengths, waits, and the models they are held against."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailspark.functions import geometry as g
from trailspark.operators import sequences
from trailspark.operators.windows import along
from trailspark.params import Queue
from trailspark.plans.intervals import DAY, GREEN, signal
from trailspark.plans.trk import LOW, TRK, query, rounded, trk


@dataclass(frozen=True)
class Approach:
    name: str
    direction: tuple[float, float]
    in_line: tuple[float, float, float, float]
    out_line: tuple[float, float, float, float]
    queue_poly: tuple[tuple[float, float], ...]


APPROACHES = (
    Approach("east", (1.0, 0.0), (60.0, 0.0, 60.0, 100.0), (160.0, 0.0, 160.0, 100.0), ((5.0, 0.0), (60.0, 0.0), (60.0, 99.5), (5.0, 99.5))),
    Approach("west", (-1.0, 0.0), (200.0, 0.0, 200.0, 100.0), (30.0, 0.0, 30.0, 100.0), ((0.0, 20.0), (90.0, 20.0), (90.0, 80.0), (0.0, 80.0))),
)


def crossings(samples: DataFrame, approach: Approach, line: tuple, margin: float = Queue.margin, refractory_s: float = Queue.refractory_s) -> DataFrame:
    """(track_id, k, t): crossings of a line in the approach's direction, ``refractory_s`` apart at least."""
    w = along()
    df = samples.select("track_id", "k", "x", "y", "t", *[F.lag(c).over(w).alias(f"p{c}") for c in ("x", "y", "t")])
    hit, part = g.crossing(F.col("px"), F.col("py"), F.col("x"), F.col("y"), line, approach.direction, margin)
    out = df.where(hit).select("track_id", "k", (F.col("pt") + part * (F.col("t") - F.col("pt"))).alias("t"))
    return sequences.refractory(out, ["track_id"], "t", refractory_s) if refractory_s > 0 else out


def queued(samples: DataFrame, approach: Approach, v_stop: float) -> DataFrame:
    """Samples that stand in the approach's polygon."""
    return samples.where((F.col("speed") < v_stop) & g.in_polygon(F.col("x"), F.col("y"), approach.queue_poly))


def queue_lengths(samples: DataFrame, approach: Approach, v_stop: float, count: str = "vehicles") -> DataFrame:
    """(k, q) for frames with a queue; ``count`` is vehicles or samples."""
    rows = queued(samples, approach, v_stop)
    return rows.groupBy("k").agg((F.count_distinct("track_id") if count == "vehicles" else F.count("*")).alias("q"))


def approach_summary(samples: DataFrame, approach: Approach, n_frames: int | None, fps: float, v_stop: float, refractory_s: float = Queue.refractory_s) -> DataFrame:
    """One row: counts, rates, queue and wait statistics; ``mu_vps`` is null below three departures out of a queue."""
    params = samples.agg((F.max("k") + 1).alias("n_frames")) if n_frames is None else samples.sparkSession.range(1).select(F.lit(n_frames).alias("n_frames"))
    arr = crossings(samples, approach, approach.in_line, refractory_s=refractory_s).agg(F.count("*").alias("n_arrivals"))
    q = queue_lengths(samples, approach, v_stop)
    dep = crossings(samples, approach, approach.out_line, refractory_s=refractory_s)
    dep = dep.join(q.select(F.col("k").alias("qk"), "q"), F.col("k") == F.col("qk"), "left").agg(F.count("*").alias("n_departures"), F.count("q").alias("served"))
    qs = q.agg(F.sum("q").alias("sum_q"), F.max("q").alias("max_queue"), F.count("*").alias("busy"))
    flagged = samples.withColumn("q", (F.col("speed") < v_stop) & g.in_polygon(F.col("x"), F.col("y"), approach.queue_poly))
    waits = sequences.wait_runs(flagged, "q", fps, ["track_id"], "k").agg(F.sum("seconds").alias("total_wait"), F.count_distinct("track_id").alias("n_cars_queued"))
    row = params.crossJoin(arr).crossJoin(dep).crossJoin(qs).crossJoin(waits)  # one row each
    seconds = F.col("n_frames") / F.lit(float(fps))
    mu = F.when(F.col("served") >= Queue.min_departures, F.try_divide(F.col("served"), F.col("busy") / F.lit(float(fps))))
    return row.select(F.lit(approach.name).alias("name"), "n_arrivals", "n_departures", F.try_divide(F.col("n_arrivals"), seconds).alias("lambda_vps"), mu.alias("mu_vps"), F.coalesce(F.try_divide(F.col("sum_q"), F.col("n_frames")), F.lit(0.0)).alias("mean_queue"), F.coalesce("max_queue", F.lit(0)).alias("max_queue"), "n_cars_queued", F.coalesce("total_wait", F.lit(0.0)).alias("total_wait"), F.try_divide("total_wait", "n_cars_queued").alias("mean_wait"))


def theory(rates: DataFrame, lam: str = "lambda_vps", mu: str = "mu_vps") -> DataFrame:
    """Adds rho and the M/D/1 and M/M/1 mean queues and waits; null, with a note, where rho is 1 or more."""
    rho = F.try_divide(lam, mu)
    ok = lambda c: F.when(F.col("rho") < 1, c)
    rates = rates.withColumn("rho", rho)
    rates = rates.withColumns({"md1_queue": ok(F.try_divide(F.col("rho") ** 2, 2 * (1 - F.col("rho")))), "mm1_queue": ok(F.try_divide(F.col("rho") ** 2, 1 - F.col("rho")))})
    return rates.withColumns({"md1_wait": F.try_divide("md1_queue", lam), "mm1_wait": F.try_divide("mm1_queue", lam), "note": F.when(F.col("rho") >= 1, "oversaturated")})


def signal_delay(cycles: DataFrame) -> DataFrame:
    """For lam, cycle, green and sat (vehicles a second): capacity, X, uniform delay d1, Webster's d2 (at most the cycle) and growth."""
    cap = F.try_divide(F.col("sat") * F.col("green"), F.col("cycle"))
    out = cycles.withColumn("cap", cap).withColumn("x_ratio", F.try_divide("lam", "cap"))
    share = F.try_divide("green", "cycle")
    d1 = F.try_divide(F.col("cycle") * (1 - share) ** 2, 2 * (1 - F.least(F.lit(1.0), F.col("x_ratio")) * share))
    d2 = F.when(F.col("x_ratio") < 1, F.least(F.try_divide(F.col("x_ratio") ** 2, 2 * F.col("lam") * (1 - F.col("x_ratio"))), F.col("cycle")))
    return out.withColumns({"d1": d1, "d2": d2, "growth": F.when(F.col("x_ratio") >= 1, F.col("lam") - F.col("cap"))})


def cycles_measured(windows: DataFrame, lengths: DataFrame, key: list[str], t_end: float | None = None) -> DataFrame:
    """Per green window, to the next one's start: red, the greatest queue and the summed queue of ``lengths`` (t, q, key)."""
    w = Window.partitionBy(*key).orderBy("t0")
    c = windows.withColumn("t2", F.lead("t0").over(w) if t_end is None else F.coalesce(F.lead("t0").over(w), F.lit(t_end))).where("t2 is not null")
    c = c.select(*key, "t0", "t2", (F.col("t2") - F.col("t0") - (F.col("t1") - F.col("t0"))).alias("red"))
    q = lengths.select(*[F.col(k).alias(f"__{k}") for k in key], F.col("t").alias("__t"), F.col("q"))
    on = (F.col("__t") >= F.col("t0")) & (F.col("__t") < F.col("t2"))
    for k in key:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return c.join(q, on, "left").groupBy(*key, "t0", "red").agg(F.coalesce(F.max("q"), F.lit(0)).alias("max_q"), F.coalesce(F.sum("q"), F.lit(0)).alias("sum_q"))


def saturation_flow(departures: DataFrame, key: list[str], max_gap: float, least: int = 8) -> DataFrame:
    """Departures a second at saturation: one over the mean of the headways below ``max_gap``, of keys with ``least`` of them."""
    w = Window.partitionBy(*key).orderBy("t")
    h = departures.withColumn("h", F.lead("t").over(w) - F.col("t")).where(F.col("h") < max_gap)
    return h.groupBy(*key).agg(F.count("*").alias("n"), F.try_divide(F.lit(1.0), F.avg("h")).alias("sat")).where(F.col("n") >= least)


def _cross_sql(name: str, x: float, sign: int) -> str:
    here, there = (f"px < {x} AND x >= {x}", "") if sign > 0 else (f"px > {x} AND x <= {x}", "")
    return f"{name} AS (SELECT track_id, k, pt + ({x} - px) / (x - px) * (t - pt) AS t FROM st WHERE {here}{there} AND (py + ({x} - px) / (x - px) * (y - py)) / 100 BETWEEN -0.15 AND 1.15)"


def _poly_sql(poly) -> str:
    parts = []
    for i, (x1, y1) in enumerate(poly):
        x0, y0 = poly[i - 1]
        if y0 != y1:
            parts.append(f"CASE WHEN (y > {y0}) <> (y > {y1}) AND x < ({x1} - {x0}) * (y - {y0}) / ({y1} - {y0}) + {x0} THEN 1 ELSE 0 END")
    return f"(({' + '.join(parts)}) % 2 = 1)"


def _base_sql(a: Approach) -> str:
    sign = 1 if a.direction[0] > 0 else -1
    return f"""{TRK}, st AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(t) OVER w AS pt, speed < {LOW} AND {_poly_sql(a.queue_poly)} AS q FROM trk WINDOW w AS (PARTITION BY track_id ORDER BY k)),
{_cross_sql('arr', a.in_line[0], sign)}, {_cross_sql('dep', a.out_line[0], sign)},
ql AS (SELECT k, count(DISTINCT track_id) AS q FROM st WHERE q GROUP BY k)"""


def _summary_sql(a: Approach) -> str:
    return f"""SELECT * FROM (WITH {_base_sql(a)},
cc AS (SELECT track_id, k, q, CASE WHEN lag(q) OVER (PARTITION BY track_id ORDER BY k) = q THEN 0 ELSE 1 END AS c FROM st), rr AS (SELECT *, sum(c) OVER (PARTITION BY track_id ORDER BY k) AS run FROM cc),
wt AS (SELECT track_id, (max(k) - min(k) + 1) / 1.0 AS s FROM rr WHERE q GROUP BY track_id, run),
nf AS (SELECT max(k) + 1 AS n FROM trk)
SELECT '{a.name}' AS name, (SELECT count(*) FROM arr) AS n_arrivals, (SELECT count(*) FROM dep) AS n_departures, round((SELECT count(*) FROM arr) / n, 6) AS lambda_vps,
  CASE WHEN (SELECT count(*) FROM dep JOIN ql USING (k)) >= 3 THEN round((SELECT count(*) FROM dep JOIN ql USING (k)) / (SELECT count(*) FROM ql), 6) END AS mu_vps,
  round((SELECT sum(q) FROM ql) / n, 6) AS mean_queue, (SELECT max(q) FROM ql) AS max_queue, (SELECT count(DISTINCT track_id) FROM wt) AS n_cars_queued, round((SELECT sum(s) FROM wt), 6) AS total_wait,
  round((SELECT sum(s) FROM wt) / (SELECT count(DISTINCT track_id) FROM wt), 6) AS mean_wait FROM nf)"""


@query(" UNION ALL ".join(_summary_sql(a) for a in APPROACHES))
def approach_summaries(spark, sf_dir):
    df = trk(spark, sf_dir)
    east, west = (approach_summary(df, a, None, 1.0, LOW, refractory_s=0) for a in APPROACHES)
    return rounded(east.unionByName(west))


@query(f"SELECT * FROM (WITH {_base_sql(APPROACHES[0])} SELECT k, q FROM ql)")
def queue_length(spark, sf_dir):
    return queue_lengths(trk(spark, sf_dir), APPROACHES[0], LOW)


@query(f"SELECT * FROM (WITH {_base_sql(APPROACHES[0])} SELECT 'arrivals' AS what, track_id, round(t, 1) AS t, row_number() OVER (ORDER BY t, track_id, k) AS n FROM arr UNION ALL SELECT 'departures', track_id, round(t, 1), row_number() OVER (ORDER BY t, track_id, k) FROM dep)")
def newell_curves(spark, sf_dir):
    """Cumulative counts: days are counted first, so no window holds more than a day's crossings."""
    df = trk(spark, sf_dir)
    a = APPROACHES[0]
    rows = crossings(df, a, a.in_line, refractory_s=0).withColumn("what", F.lit("arrivals")).unionByName(crossings(df, a, a.out_line, refractory_s=0).withColumn("what", F.lit("departures")))
    rows = rows.withColumn("day", F.floor(F.col("t") / DAY))
    days = rows.groupBy("what", "day").agg(F.count("*").alias("c")).withColumn("before", F.sum("c").over(Window.partitionBy("what").orderBy("day")) - F.col("c"))
    inside = F.row_number().over(Window.partitionBy("what", "day").orderBy("t", "track_id", "k"))
    out = rows.withColumn("i", inside).join(F.broadcast(days), ["what", "day"])
    return rounded(out.select("what", "track_id", "t", (F.col("before") + F.col("i")).alias("n")), 1)


RATES = f"{TRK}, r AS (SELECT track_id, count(*) FILTER (cls = 'click') / (max(t) - min(t)) AS lambda_vps, count(*) FILTER (cls = 'view') / (max(t) - min(t)) AS mu_vps FROM trk GROUP BY track_id)"


@query(
    f"""WITH {RATES}, q AS (SELECT *, lambda_vps / nullif(mu_vps, 0) AS rho FROM r)
SELECT track_id, round(rho, 6) AS rho, CASE WHEN rho < 1 THEN round(rho * rho / (2 * (1 - rho)), 6) END AS md1_queue, CASE WHEN rho < 1 THEN round(rho * rho / (1 - rho), 6) END AS mm1_queue,
  CASE WHEN rho < 1 THEN round(rho * rho / (2 * (1 - rho)) / nullif(lambda_vps, 0), 2) END AS md1_wait, CASE WHEN rho >= 1 THEN 'oversaturated' END AS note FROM q"""
)
def queue_theory(spark, sf_dir):
    span = F.max("t") - F.min("t")
    rates = trk(spark, sf_dir).groupBy("track_id").agg((F.count(F.when(F.col("cls") == "click", 1)) / span).alias("lambda_vps"), (F.count(F.when(F.col("cls") == "view", 1)) / span).alias("mu_vps"))
    out = theory(rates)
    return out.select("track_id", *[F.round(c, 6).alias(c) for c in ("rho", "md1_queue", "mm1_queue")], F.round("md1_wait", 2).alias("md1_wait"), "note")


@query(
    f"""WITH {GREEN}, n AS (SELECT *, lead(t0) OVER (PARTITION BY track_id ORDER BY t0) AS t2 FROM gw), q AS (SELECT track_id, t, 1 AS q FROM trk WHERE speed < {LOW})
SELECT n.track_id, round(n.t0, 3) AS t0, round(t2 - n.t1, 3) AS red, coalesce(max(q), 0)::BIGINT AS max_q, coalesce(sum(q), 0)::BIGINT AS sum_q FROM n LEFT JOIN q ON q.track_id = n.track_id AND q.t >= n.t0 AND q.t < t2 WHERE t2 IS NOT NULL GROUP BY n.track_id, n.t0, n.t1, t2"""
)
def cycle_compare(spark, sf_dir):
    df = trk(spark, sf_dir)
    windows = sequences.green_windows(signal(df), ["track_id"])
    lengths = df.where(F.col("speed") < LOW).select("track_id", "t", F.lit(1).alias("q"))
    return rounded(cycles_measured(windows, lengths, ["track_id"]), 3).withColumn("max_q", F.col("max_q").cast("long")).withColumn("sum_q", F.col("sum_q").cast("long"))


@query(
    f"""WITH {TRK}, h AS (SELECT track_id, lead(t) OVER (PARTITION BY track_id ORDER BY t) - t AS h FROM trk)
SELECT track_id, count(*) AS n, round(1000 / avg(h), 6) AS sat FROM h WHERE h < 20000 GROUP BY track_id HAVING count(*) >= 8"""
)
def saturation_flows(spark, sf_dir):
    out = saturation_flow(trk(spark, sf_dir).select("track_id", "t"), ["track_id"], 20000.0)
    return out.select("track_id", "n", F.round(F.col("sat") * 1000, 6).alias("sat"))


@query(
    f"""WITH {GREEN}, z AS (SELECT track_id, t0 - lag(t0) OVER (PARTITION BY track_id ORDER BY t0) AS gap, t1 - t0 AS g FROM gw),
c AS (SELECT track_id, quantile_cont(gap, 0.5) AS cycle, quantile_cont(g, 0.5) AS green FROM z GROUP BY track_id HAVING count(*) >= 2),
l AS (SELECT track_id, count(*) / 2592000.0 AS lam FROM trk GROUP BY track_id),
d AS (SELECT track_id, cycle, green, lam, 0.0001 * green / cycle AS cap, lam / (0.0001 * green / cycle) AS xr FROM c JOIN l USING (track_id))
SELECT track_id, round(xr, 5) AS x_ratio, round(cycle * power(1 - green / cycle, 2) / (2 * (1 - least(1, xr) * green / cycle)), 2) AS d1, CASE WHEN xr < 1 THEN round(least(xr * xr / (2 * lam * (1 - xr)), cycle), 2) END AS d2, CASE WHEN xr >= 1 THEN round((lam - cap) * 1000, 6) END AS growth FROM d"""
)
def signal_delays(spark, sf_dir):
    df = trk(spark, sf_dir)
    c = sequences.cycle_timing(sequences.green_windows(signal(df), ["track_id"]), ["track_id"])
    lam = df.groupBy("track_id").agg((F.count("*") / F.lit(2592000.0)).alias("lam"))
    out = signal_delay(c.join(lam, "track_id").withColumn("sat", F.lit(0.0001)))
    return out.select("track_id", F.round("x_ratio", 5).alias("x_ratio"), F.round("d1", 2).alias("d1"), F.round("d2", 2).alias("d2"), F.round(F.col("growth") * 1000, 6).alias("growth"))


_TURN = "degrees(atan2(1.0 * ny, 1.0 * nx))"


@query(
    f"""WITH {TRK}, n AS (SELECT track_id, arg_min(cls, k) AS entry, arg_max(x, k) - arg_min(x, k) AS nx, arg_max(y, k) - arg_min(y, k) AS ny FROM trk GROUP BY track_id),
m AS (SELECT entry, CASE WHEN abs({_TURN}) <= 45 THEN 'straight' WHEN abs({_TURN}) >= 135 THEN 'uturn' WHEN {_TURN} > 0 THEN 'right' ELSE 'left' END AS movement FROM n)
SELECT entry, count(*) FILTER (movement = 'left') AS "left", count(*) FILTER (movement = 'right') AS "right", count(*) FILTER (movement = 'straight') AS straight, count(*) FILTER (movement = 'uturn') AS uturn FROM m GROUP BY entry"""
)
def movement_rollup(spark, sf_dir):
    n = trk(spark, sf_dir).groupBy("track_id").agg(F.min_by("cls", "k").alias("entry"), F.max_by(F.struct("x", "y"), "k").alias("b"), F.min_by(F.struct("x", "y"), "k").alias("a"))
    turn = g.turn_degrees(1.0, 0.0, F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y"))
    kinds = ["left", "right", "straight", "uturn"]
    return n.select("entry", g.movement(turn).alias("movement")).groupBy("entry").pivot("movement", kinds).count().select("entry", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])
