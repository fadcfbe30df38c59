"""Ground-truth profiles, comparisons and the quality report."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailspark.operators import sequences
from trailspark.plans.kinematics import STATES, with_state
from trailspark.plans.trk import LOW, TRK, query, rounded, trk

DAY = 86400


@query(
    f"""WITH {TRK}, c AS (SELECT track_id, arg_min(cls, k) AS cls FROM trk GROUP BY track_id)
SELECT cls, count(*) AS n FROM c GROUP BY cls"""
)
def class_mix(spark, sf_dir):
    """Tracks by the class of their first sample."""
    return trk(spark, sf_dir).groupBy("track_id").agg(F.min_by("cls", "k").alias("cls")).groupBy("cls").agg(F.count("*").alias("n"))


@query(
    f"""WITH {TRK}, b AS (SELECT floor(t / {DAY})::BIGINT AS day, track_id, speed FROM trk), s AS (SELECT day, count(DISTINCT track_id) AS n FROM b WHERE speed < {LOW} GROUP BY day),
sp AS (SELECT unnest(range(min(day), max(day) + 1)) AS day FROM b)
SELECT sp.day, coalesce(n, 0) AS stopped FROM sp LEFT JOIN s USING (day)"""
)
def stopped_per_bin(spark, sf_dir):
    """Distinct stopped tracks of each day, days without any as 0."""
    b = trk(spark, sf_dir).withColumn("day", F.floor(F.col("t") / DAY))
    s = b.where(F.col("speed") < LOW).groupBy("day").agg(F.count_distinct("track_id").alias("n"))
    spine = b.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return spine.join(s, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("stopped"))


@query(
    f"""WITH {STATES}, ours AS (SELECT day, count(*) AS a FROM (SELECT unnest(range(floor(t0 / {DAY})::BIGINT, floor(t1 / {DAY})::BIGINT + 1)) AS day FROM runs WHERE stopped) GROUP BY day),
them AS (SELECT floor(t / {DAY})::BIGINT AS day, count(DISTINCT track_id) AS b FROM trk WHERE speed < {LOW} GROUP BY 1), j AS (SELECT a, b FROM ours JOIN them USING (day))
SELECT count(*) AS n, round(corr(a, b), 6) AS corr, round(avg(abs(a - b)), 6) AS mae FROM j"""
)
def stopped_series_compare(spark, sf_dir):
    """Runs covering each day against distinct stopped tracks of it."""
    df = with_state(trk(spark, sf_dir))
    runs = sequences.runs(df, "stopped").where("stopped")
    ours = runs.select(F.explode(F.sequence(F.floor(F.col("t0") / DAY), F.floor(F.col("t1") / DAY))).alias("day")).groupBy("day").agg(F.count("*").alias("a"))
    them = df.where(F.col("speed") < LOW).groupBy(F.floor(F.col("t") / DAY).alias("day")).agg(F.count_distinct("track_id").alias("b"))
    j = ours.join(them, "day")
    return rounded(j.agg(F.count("*").alias("n"), F.corr("a", "b").alias("corr"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mae")))


@query(
    f"""WITH {STATES}, v AS (SELECT track_id, run_no, quantile_cont(speed, 0.5) AS m FROM rn WHERE stopped GROUP BY track_id, run_no HAVING count(*) >= 2)
SELECT round(quantile_cont(m, 0.5), 6) AS median_stopped, round(avg(CASE WHEN m < 15 THEN 1.0 ELSE 0.0 END), 6) AS share_slow, count(*) AS n_runs,
  (SELECT count(*) FROM runs WHERE stopped) AS stopped_runs, (SELECT count(DISTINCT track_id) FROM trk) AS tracks FROM v"""
)
def qa_report(spark, sf_dir):
    """The one-row report: medians and shares over stopped runs."""
    df = with_state(trk(spark, sf_dir))
    r = sequences.runs(df, "stopped").where("stopped").select(F.col("track_id").alias("id"), "run_no", "f0", "f1")
    v = df.join(r, (F.col("track_id") == F.col("id")) & F.col("k").between(F.col("f0"), F.col("f1"))).groupBy("track_id", "run_no").agg(F.percentile("speed", F.lit(0.5)).alias("m"), F.count("*").alias("n"))
    row = v.where("n >= 2").agg(F.percentile("m", F.lit(0.5)).alias("median_stopped"), F.avg(F.when(F.col("m") < 15, 1.0).otherwise(0.0)).alias("share_slow"), F.count("*").alias("n_runs"))
    return rounded(row.crossJoin(r.agg(F.count("*").alias("stopped_runs"))).crossJoin(df.agg(F.count_distinct("track_id").alias("tracks"))))


@query(
    f"""WITH {TRK} SELECT CASE WHEN k < 20 THEN 'early' WHEN k < 50 THEN 'mid' ELSE 'late' END AS band, round(quantile_cont(abs(speed - 60), 0.5), 6) AS median, round(quantile_cont(abs(speed - 60), 0.9), 6) AS p90 FROM trk GROUP BY 1"""
)
def residual_bands(spark, sf_dir):
    """Median and 90th percentile of residuals by frame band."""
    band = F.when(F.col("k") < 20, "early").when(F.col("k") < 50, "mid").otherwise("late")
    r = F.abs(F.col("speed") - 60)
    return rounded(trk(spark, sf_dir).groupBy(band.alias("band")).agg(F.percentile(r, F.lit(0.5)).alias("median"), F.percentile(r, F.lit(0.9)).alias("p90")))
