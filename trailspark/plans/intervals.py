"""As-of, interval, band and phase queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailspark.operators import joins, sequences
from trailspark.plans.kinematics import STATES, with_state
from trailspark.plans.trk import LOW, TRK, query, rounded, table, trk

DAY = 86400.0
GREEN = f"""{TRK}, on_ AS (SELECT track_id, t, cls = 'purchase' AS g FROM trk), ed AS (SELECT *, coalesce(lag(g) OVER (PARTITION BY track_id ORDER BY t), false) AS b FROM on_),
ch AS (SELECT * FROM ed WHERE g <> b), nx AS (SELECT *, lead(t) OVER (PARTITION BY track_id ORDER BY t) AS t1 FROM ch),
gw AS (SELECT track_id, t AS t0, t1 FROM nx WHERE g AND t1 IS NOT NULL)"""


def signal(df):
    return df.select("track_id", "t", F.when(F.col("cls") == "purchase", 1).otherwise(0).alias("state"))


@query(f"WITH {GREEN} SELECT track_id, round(t0, 3) AS t0, round(t1, 3) AS t1 FROM gw")
def green_windows(spark, sf_dir):
    return rounded(sequences.green_windows(signal(trk(spark, sf_dir)), ["track_id"]), 3)


@query(
    f"""WITH {GREEN}, z AS (SELECT track_id, t0 - lag(t0) OVER (PARTITION BY track_id ORDER BY t0) AS gap, t1 - t0 AS g FROM gw)
SELECT track_id, count(*) AS n, round(quantile_cont(gap, 0.5), 3) AS cycle, round(quantile_cont(g, 0.5), 3) AS green FROM z GROUP BY track_id HAVING count(*) >= 2"""
)
def cycle_timing(spark, sf_dir):
    return rounded(sequences.cycle_timing(sequences.green_windows(signal(trk(spark, sf_dir)), ["track_id"]), ["track_id"]), 3)


@query(
    f"""WITH {TRK}, e AS (SELECT track_id, t, count(*) OVER (PARTITION BY track_id) AS n, CASE WHEN t - lag(t) OVER (PARTITION BY track_id ORDER BY t) > {2 * DAY} THEN 1 ELSE 0 END AS new FROM trk WHERE cls = 'purchase'),
p AS (SELECT *, sum(new) OVER (PARTITION BY track_id ORDER BY t) AS platoon FROM e WHERE n >= 5)
SELECT track_id, platoon::BIGINT AS platoon, round(min(t) - 60, 3) AS t0, round(max(t) + 60, 3) AS t1, count(*) AS n FROM p GROUP BY track_id, platoon HAVING count(*) >= 2"""
)
def platoons(spark, sf_dir):
    e = trk(spark, sf_dir).where("cls = 'purchase'").select("track_id", "t")
    return rounded(sequences.platoons(e, ["track_id"], 2 * DAY, 2, 5, 60.0), 3)


@query(
    f"""WITH {TRK}, f AS (SELECT track_id, k, speed < {LOW} AS q, max(k) OVER (PARTITION BY track_id) AS e FROM trk),
c AS (SELECT *, CASE WHEN lag(q) OVER (PARTITION BY track_id ORDER BY k) = q THEN 0 ELSE 1 END AS c FROM f), r AS (SELECT *, sum(c) OVER (PARTITION BY track_id ORDER BY k) AS run FROM c)
SELECT track_id, min(k) AS f0, max(k) AS f1, round((max(k) - min(k) + 1) / 25.0, 6) AS seconds, max(k) = max(e) AS truncated FROM r WHERE q GROUP BY track_id, run"""
)
def wait_runs(spark, sf_dir):
    df = trk(spark, sf_dir).withColumn("q", F.col("speed") < LOW)
    return rounded(sequences.wait_runs(df, "q", 25.0, ["track_id"], "k"))


@query(
    f"""WITH {TRK}, f AS (SELECT track_id, t, speed < {LOW} AS q, lead(t) OVER (PARTITION BY track_id ORDER BY t) AS nx FROM trk),
c AS (SELECT *, CASE WHEN lag(q) OVER (PARTITION BY track_id ORDER BY t) = q THEN 0 ELSE 1 END AS c FROM f), r AS (SELECT *, sum(c) OVER (PARTITION BY track_id ORDER BY t) AS run FROM c)
SELECT track_id, round(min(t), 3) AS t0, round(max(coalesce(nx, t)), 3) AS t1, round(max(coalesce(nx, t)) - min(t), 3) AS seconds FROM r WHERE q GROUP BY track_id, run"""
)
def stop_waits(spark, sf_dir):
    df = trk(spark, sf_dir).withColumn("q", F.col("speed") < LOW)
    return rounded(sequences.stop_waits(df, "q", ["track_id"]), 3)


def _sides(df):
    return df.where("cls = 'click'").select("track_id", "t", "k"), df.where("cls = 'purchase'").select("track_id", "t", "speed")


@query(
    f"""WITH {TRK} SELECT c.track_id, c.k, round((SELECT arg_max(p.speed, p.t) FROM trk p WHERE p.cls = 'purchase' AND p.track_id = c.track_id AND p.t <= c.t), 6) AS asof_speed FROM trk c WHERE c.cls = 'click'"""
)
def asof_backward(spark, sf_dir):
    left, right = _sides(trk(spark, sf_dir))
    return rounded(joins.asof(left, right, "track_id", "t", "speed").select("track_id", "k", "asof_speed"))


@query(
    f"""WITH {TRK} SELECT c.track_id, c.k, round((SELECT arg_min(p.speed, p.t) FROM trk p WHERE p.cls = 'purchase' AND p.track_id = c.track_id AND p.t > c.t), 6) AS asof_speed FROM trk c WHERE c.cls = 'click'"""
)
def asof_forward(spark, sf_dir):
    left, right = _sides(trk(spark, sf_dir))
    return rounded(joins.asof(left, right, "track_id", "t", "speed", forward=True, strict=True).select("track_id", "k", "asof_speed"))


@query(f"WITH {GREEN} SELECT track_id, k FROM trk s WHERE cls = 'click' AND EXISTS (SELECT 1 FROM gw WHERE gw.track_id = s.track_id AND s.t BETWEEN gw.t0 AND gw.t1 + {DAY})")
def in_green(spark, sf_dir):
    df = trk(spark, sf_dir)
    windows = sequences.green_windows(signal(df), ["track_id"]).withColumn("t1", F.col("t1") + DAY)
    return joins.within(df.where("cls = 'click'").select("track_id", "k", "t"), windows, ["track_id"], "t", "t0", "t1").select("track_id", "k")


@query(
    f"""WITH {TRK} SELECT c.track_id, c.k, count(*) AS n, round(max(p.speed), 6) AS top FROM trk c JOIN trk p ON p.track_id = c.track_id AND p.cls = 'purchase' AND p.t BETWEEN c.t - {DAY} AND c.t + {DAY / 2} WHERE c.cls = 'click' GROUP BY c.track_id, c.k"""
)
def band_join(spark, sf_dir):
    left, right = _sides(trk(spark, sf_dir))
    pairs = joins.band(left.withColumnRenamed("t", "lt"), right.withColumnRenamed("t", "rt"), "lt", "rt", DAY, DAY / 2, DAY, ["track_id"])
    return rounded(pairs.groupBy("track_id", "k").agg(F.count("*").alias("n"), F.max("speed").alias("top")))


@query(f"WITH {STATES} SELECT s.track_id, s.k FROM trk s WHERE s.cls = 'click' AND EXISTS (SELECT 1 FROM runs r WHERE r.track_id = s.track_id AND r.stopped AND s.k BETWEEN r.f0 AND r.f1)")
def samples_in_stops(spark, sf_dir):
    df = with_state(trk(spark, sf_dir))
    stops = sequences.runs(df, "stopped").where("stopped")
    return joins.within(df.where("cls = 'click'").select("track_id", "k"), stops, ["track_id"], "k", "f0", "f1")


@query("WITH c AS (SELECT user_id, min(epoch_us(ts) / 1e6) AS a, max(epoch_us(ts) / 1e6) AS d FROM events WHERE event_type IN ('click', 'purchase') GROUP BY user_id, event_type) SELECT a.user_id AS track_id, round(b.d - a.a, 3) AS trip FROM (SELECT user_id, min(a) AS a FROM c GROUP BY 1) a JOIN (SELECT user_id, max(epoch_us(ts) / 1e6) AS d FROM events WHERE event_type = 'purchase' GROUP BY 1) b USING (user_id) WHERE b.d > a.a")
def arrival_departure(spark, sf_dir):
    """First sample of a click or purchase to the last purchase, where it is later."""
    df = trk(spark, sf_dir)
    a = df.where("cls in ('click', 'purchase')").groupBy("track_id").agg(F.min("t").alias("a"))
    d = df.where("cls = 'purchase'").groupBy("track_id").agg(F.max("t").alias("d"))
    return rounded(a.join(d, "track_id").where("d > a").select("track_id", (F.col("d") - F.col("a")).alias("trip")), 3)


@query("SELECT DISTINCT user_id AS track_id FROM events WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 200)")
def truncated_tracks(spark, sf_dir):
    """Arrivals without a departure."""
    df = trk(spark, sf_dir)
    return df.where("cls = 'click'").select("track_id").distinct().join(df.where("cls = 'purchase' and x > 200"), "track_id", "left_anti")


@query("WITH band AS (SELECT user_id FROM events GROUP BY 1 HAVING quantile_cont(value, 0.5) BETWEEN 30 AND 60) SELECT user_id AS track_id FROM band WHERE user_id NOT IN (4, 8, 15) UNION SELECT user_id FROM events WHERE user_id IN (16, 23, 42) AND user_id NOT IN (4, 8, 15)")
def focus_ids(spark, sf_dir):
    """Tracks whose median offset is in the band, with some more, without some others."""
    df = trk(spark, sf_dir)
    band = df.groupBy("track_id").agg(F.percentile("x", F.lit(0.5)).alias("m")).where("m between 30 and 60").select("track_id")
    more = df.where(F.col("track_id").isin(16, 23, 42)).select("track_id")
    return band.union(more).distinct().where(~F.col("track_id").isin(4, 8, 15))


@query("WITH s AS (SELECT l_suppkey, epoch_us(l_shipdate) / 1e6 AS t FROM lineitem), h AS (SELECT l_suppkey, lead(t) OVER (PARTITION BY l_suppkey ORDER BY t) - t AS g FROM s) SELECT l_suppkey, count(g) AS n, round(avg(g), 3) AS mean, round(quantile_cont(g, 0.9), 3) AS p90 FROM h GROUP BY l_suppkey")
def ship_headways(spark, sf_dir):
    from trailspark.sources.trajectories import headways

    s = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / F.lit(1e6)).alias("t"))
    h = headways(s, ["l_suppkey"])
    return rounded(h.groupBy("l_suppkey").agg(F.count("headway").alias("n"), F.avg("headway").alias("mean"), F.percentile("headway", F.lit(0.9)).alias("p90")), 3)
