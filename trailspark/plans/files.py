"""Sources and sinks as queries: the tracks written in each format to the shared folder, and read back by the format's reader."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.operators import sequences
from trailspark.operators.lineage import shared_dir
from trailspark.sources import artifacts, schemas, trajectories
from trailspark.plans.trk import TRK, query, rounded, trk


def _place(spark) -> str:
    return f"{shared_dir(spark).rstrip('/')}/trailspark/files-{uuid.uuid4().hex}"


def _boxes(df: DataFrame) -> DataFrame:
    return df.select("track_id", "cls", F.col("k").alias("frame"), F.round("x", 3).alias("cx"), F.round("y", 3).alias("cy"))


@query(f"WITH {TRK} SELECT track_id::INT AS track_id, cls, k::INT AS frame, round(x, 3) AS cx, round(y, 3) AS cy, 0.5 AS conf FROM trk WHERE cls IN ('click', 'view')".replace("0.5 AS conf", "0.5::DOUBLE AS conf"))
def artifact_observations(spark, sf_dir):
    """Track documents written as JSON, one for each clip, and read as observations of two classes."""
    path = _place(spark)
    obs = F.array_sort(F.collect_list(F.array(F.col("frame").cast("double"), "cx", "cy", F.lit(4.0), F.lit(2.0), F.lit(0.5)))).alias("obs")
    tracks = _boxes(trk(spark, sf_dir)).groupBy("track_id", "cls").agg(obs)
    docs = tracks.groupBy((F.col("track_id") % 5).alias("clip")).agg(F.collect_list(F.struct(F.col("track_id").cast("int").alias("id"), "cls", "obs")).alias("tracks"))
    artifacts.save_json(docs.withColumn("model", F.lit("m")), path)
    return artifacts.observations(artifacts.load(spark, path, schemas.TRACKS), ("click", "view")).drop("w", "h")


@query(f"WITH {TRK} SELECT 'run ' || (track_id % 3) AS label, count(*)::DOUBLE AS m1, round(sum(y), 3) AS m2 FROM trk GROUP BY 1 UNION ALL SELECT 'again', 1.0, NULL")
def metrics_log(spark, sf_dir):
    """Metrics appended to a log by two writers, read as one."""
    path = _place(spark)
    rows = trk(spark, sf_dir).groupBy(F.concat(F.lit("run "), (F.col("track_id") % 3).cast("string")).alias("label")).agg(F.count("*").cast("double").alias("m1"), F.sum("y").alias("m2"))
    artifacts.append_metrics(rows, path)
    artifacts.append_metrics(spark.createDataFrame([("again", 1.0)], "label string, m1 double"), path)
    return rounded(artifacts.read_metrics(spark, path).select("label", "m1", "m2"), 3)


_WIDE = "n AS (SELECT *, count(*) OVER (PARTITION BY track_id) - count(*) FILTER (k % 9 = 4) OVER (PARTITION BY track_id) AS valid, arg_min(cls, k) OVER (PARTITION BY track_id) AS kind FROM trk)"


@query(f"WITH {TRK}, {_WIDE} SELECT track_id::INT AS track_id, kind AS cls, k / 10.0 AS t, CASE WHEN k % 5 = 0 THEN NULL ELSE round(x, 2) END AS lat, round(y, 2) AS lon, round(round(speed, 2) / 3.6, 6) AS speed FROM n WHERE k % 9 <> 4 AND valid >= 60 AND kind <> 'error'")
def wide_rows(spark, sf_dir):
    """Delimited text of one track a line, with empty cells and samples without a time; short tracks and another class are left out."""
    path = _place(spark)
    k = F.col("k")
    cell = lambda c: F.round(c, 2).cast("string")
    block = F.concat_ws(";", F.when(k % 5 == 0, "").otherwise(cell("x")), cell("y"), cell("speed"), F.lit("0"), F.lit(""), F.when(k % 9 == 4, "").otherwise((k / 10).cast("string")))
    rows = trk(spark, sf_dir).groupBy("track_id").agg(F.min_by("cls", "k").alias("cls"), F.array_sort(F.collect_list(F.struct("k", block.alias("b")))).alias("bs"))
    line = F.concat_ws(";", F.col("track_id").cast("string"), F.concat(F.lit(" "), "cls", F.lit(" ")), F.lit("1.5"), F.lit("2"), F.array_join("bs.b", ";"), F.lit(" "))
    rows.select(line.alias("value")).unionByName(spark.createDataFrame([("track_id; type; traveled_d; avg_speed; lat; lon",)], "value string")).write.text(path)
    kept = ("click", "purchase", "scroll", "signup", "view", "login", "logout")
    out = trajectories.read_wide(spark, path, kept, 60)
    parameters = {"keep": kept, "least": 60}
    cache = _place(spark)
    artifacts.cached(spark, cache, parameters, lambda: out)
    return rounded(artifacts.cached(spark, cache, parameters, lambda: out.where("false")))


@query(f"WITH {TRK} SELECT track_id::INT AS track_id, k::INT AS frame, k / 10.0 AS t, round(x, 3) AS x, round(sqrt(power(round(speed, 3), 2) + power(round(y, 3), 2)), 6) AS speed FROM trk WHERE cls = 'click'")
def csv_trajectories(spark, sf_dir):
    """A CSV of trajectories with velocities, one class kept."""
    path = _place(spark)
    df = trk(spark, sf_dir).select("track_id", F.col("k").alias("frame_id"), (F.col("k") * 100.0).alias("timestamp_ms"), F.col("cls").alias("agent_type"), F.round("x", 3).alias("x"), F.lit(0.0).alias("y"), F.round("speed", 3).alias("vx"), F.round("y", 3).alias("vy"))
    df.write.option("header", True).csv(path)
    return rounded(trajectories.read_intersection(spark, path, ("click",)).select("track_id", "frame", "t", "x", "speed"))


_HEADS = "s AS (SELECT DISTINCT t, floor(t / 7200)::BIGINT % 3 AS a, floor(t / 5400)::BIGINT % 2 AS b FROM trk)"


@query(
    f"""WITH {TRK}, {_HEADS}, l AS (SELECT 'A' AS head, t, a = 1 AS g FROM s UNION ALL SELECT 'B', t, b = 1 FROM s), e AS (SELECT *, coalesce(lag(g) OVER (PARTITION BY head ORDER BY t), false) AS p FROM l), c AS (SELECT * FROM e WHERE g <> p),
n AS (SELECT *, lead(t) OVER (PARTITION BY head ORDER BY t) AS t1 FROM c) SELECT head, round(t, 3) AS t0, round(t1, 3) AS t1 FROM n WHERE g AND t1 IS NOT NULL"""
)
def csv_signals(spark, sf_dir):
    """Signal heads in the columns of a CSV, read as green windows."""
    path = _place(spark)
    t = F.col("t")
    rows = trk(spark, sf_dir).select("t").distinct().select((t * 1000).alias("timestamp(ms)"), (F.floor(t / 7200) % 3).alias("A"), (F.floor(t / 5400) % 2).alias("B"))
    rows.write.option("header", True).csv(path)
    return rounded(sequences.green_windows(trajectories.read_signals(spark, path, ["A", "B"]), ["head"]), 3)


@query(f"WITH {TRK}, c AS (SELECT track_id, k, (k % 24) * 3600 + (k % 60) * 60 + round(y / 2, 3) AS s, round(speed, 2) AS speed FROM trk) SELECT track_id::INT AS vehicle, k::INT AS row, round(s - (SELECT min(s) FROM c), 3) AS t, speed FROM c")
def csv_truth(spark, sf_dir):
    """Ground truth with clock times, as seconds since its first."""
    path = _place(spark)
    k = F.col("k")
    clock = F.concat_ws(":", (k % 24).cast("string"), (k % 60).cast("string"), F.round(F.col("y") / 2, 3).cast("string"))
    trk(spark, sf_dir).select(clock.alias("Local_Time"), F.lit(1).alias("Drone_ID"), F.col("track_id").alias("Vehicle_ID"), k.alias("Vehicle_Class"), F.lit("N").alias("Road_Section"), F.round("speed", 2).alias("Vehicle_Speed"), F.lit(1).alias("Visibility")).write.option("header", True).csv(path)
    rows = trajectories.read_truth(spark, path)
    return rounded(rows.select(F.col("Vehicle_ID").alias("vehicle"), F.col("Vehicle_Class").alias("row"), "t", F.col("Vehicle_Speed").alias("speed")), 3)


@query(
    f"""WITH {TRK}, o AS (SELECT DISTINCT track_id::INT AS track_id, 10 AS frame, 'stopped' AS state FROM trk UNION ALL SELECT DISTINCT track_id::INT, 20, 'rolling' FROM trk),
a AS (SELECT track_id, frame, CASE WHEN frame = 10 AND track_id % 2 = 0 THEN 'braking' ELSE state END AS state FROM o) SELECT * FROM a WHERE track_id <> 3 AND NOT (track_id = 4 AND frame = 20)"""
)
def override_documents(spark, sf_dir):
    """An override document read, added to (equal track and frame replaced, unknown states refused), taken from, written and read again."""
    path = _place(spark)
    ids = trk(spark, sf_dir).select(F.col("track_id").cast("int").alias("track")).distinct()
    rows = ids.withColumn("o", F.explode(F.array(F.struct(F.lit(10).alias("frame"), F.lit("stopped").alias("state")), F.struct(F.lit(20).alias("frame"), F.lit("rolling").alias("state")), F.struct(F.lit(30).alias("frame"), F.lit("flying").alias("state"))))).select("track", "o.frame", "o.state")

    def write(rows, to):
        artifacts.save_json(rows.groupBy((F.col("track") % 3).alias("clip")).agg(F.collect_list(F.struct("track", "frame", "state")).alias("overrides")), to)

    write(rows, f"{path}-a")
    now = artifacts.overrides(artifacts.load(spark, f"{path}-a", schemas.OVERRIDES))
    new = now.select("track_id").distinct().where("track_id % 2 = 0").withColumn("o", F.explode(F.array(F.struct(F.lit(10).alias("frame"), F.lit("braking").alias("state")), F.struct(F.lit(40).alias("frame"), F.lit("gone").alias("state"))))).select("track_id", "o.frame", "o.state")
    now = artifacts.remove_override(artifacts.remove_override(artifacts.add_override(now, new), 3), 4, 20)
    write(now.withColumnRenamed("track_id", "track"), f"{path}-b")
    return artifacts.overrides(artifacts.load(spark, f"{path}-b", schemas.OVERRIDES)).select("track_id", "frame", "state")


@query(f"WITH {TRK}, f AS (SELECT DISTINCT k AS frame FROM trk) SELECT frame::INT AS frame, 1.0 + frame / 100.0 AS first, 2.0 + frame / 100.0 AS now, frame::INT AS inliers FROM f".replace("1.0 + frame / 100.0 AS first, 2.0 + frame / 100.0", "round(1.0 + frame / 100.0, 6) AS first, round(2.0 + frame / 100.0, 6)"))
def refined_homographies(spark, sf_dir):
    """Homographies written, backed up once, replaced twice: what was first stays in the backup."""
    path, backup = _place(spark), _place(spark)
    frames = trk(spark, sf_dir).select(F.col("k").alias("frame")).distinct()
    row = lambda *v: F.array(*[F.lit(x).cast("double") if not hasattr(x, "alias") else x for x in v])
    for first in (1.0, 5.0, 2.0):
        a = first + F.col("frame") / 100
        m = F.array(row(a, 0, 0), row(0, 1, 0), row(0, 0, 1))
        doc = frames.agg(F.array_sort(F.collect_list(F.struct("frame", m.alias("h"), F.col("frame").cast("int").alias("i")))).alias("z")).select(F.lit("chain").alias("method"), F.col("z.h").alias("H"), F.col("z.i").alias("inliers"))
        artifacts.save_json(doc, path)
        artifacts.backed_up(spark, path, backup)
    read = lambda p, name: artifacts.homographies(artifacts.load(spark, p, schemas.HOMOGRAPHIES)).select("frame", F.round("h11", 6).alias(name), "inliers")
    return read(backup, "first").drop("inliers").join(read(path, "now"), "frame")


@query(f"WITH {TRK} SELECT track_id::INT AS track_id, k::INT AS frame, round(x, 2) AS vx, round(y, 2) AS vy, (k % 6)::INT AS n FROM trk")
def flow_documents(spark, sf_dir):
    """Flow documents of parallel arrays, read as rows."""
    path = _place(spark)
    names = {"frames": F.col("k").cast("int"), "vx": F.round("x", 2), "vy": F.round("y", 2), "n": (F.col("k") % 6).cast("int"), "spread": F.lit(0.5), "jac": F.lit(1.0)}
    rows = trk(spark, sf_dir).groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct(*[c.alias(n) for n, c in names.items()]))).alias("z"))
    docs = rows.groupBy((F.col("track_id") % 4).alias("clip")).agg(F.collect_list(F.struct(F.col("track_id").cast("int").alias("id"), *[F.col(f"z.{n}").alias(n) for n in names])).alias("tracks"))
    artifacts.save_json(docs, path)
    return artifacts.flow(artifacts.load(spark, path, schemas.FLOW)).select("track_id", "frame", "vx", "vy", "n")
