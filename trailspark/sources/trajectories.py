"""Readers of external trajectory data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailspark.functions.geometry import clock_seconds, local_metres

META_CELLS, SAMPLE_CELLS = 4, 6


def parse_wide(lines: DataFrame, keep: tuple[str, ...] | None = None, min_samples: int = 5) -> DataFrame:
    """Rows (track_id, cls, t, lat, lon, speed in m/s) of lines ``value`` with ';' between cells.

    Four cells of the track, then blocks of lat; lon; speed in km/h; two accelerations;
    seconds. Empty cells are null, samples without a time are dropped, as are tracks with
    fewer than ``min_samples`` of them, the header, and classes that aren't to be kept.
    """
    cells = F.transform(F.split("value", ";"), lambda c: F.trim(c))
    number = lambda c: F.nullif(c, F.lit("")).try_cast("double")
    blocks = F.sequence(F.lit(META_CELLS), F.greatest(F.size("c") - 1, F.lit(META_CELLS)), F.lit(SAMPLE_CELLS))

    def sample(i: Column) -> Column:
        at = lambda j: number(F.get(F.col("c"), i + j))
        return F.struct(at(0).alias("lat"), at(1).alias("lon"), (at(2) / 3.6).alias("speed"), at(5).alias("t"))

    rows = lines.select(cells.alias("c")).where(F.col("c")[0].try_cast("int").isNotNull())
    rows = rows.select(F.col("c")[0].cast("int").alias("track_id"), F.get("c", F.lit(1)).alias("cls"), F.filter(F.transform(blocks, sample), lambda s: s["t"].isNotNull()).alias("s"))
    if keep:
        rows = rows.where(F.col("cls").isin(*keep))
    return rows.where(F.size("s") >= min_samples).select("track_id", "cls", F.explode("s").alias("s")).select("track_id", "cls", "s.t", "s.lat", "s.lon", "s.speed")


def read_wide(spark: SparkSession, path: str, keep: tuple[str, ...] | None = None, min_samples: int = 5) -> DataFrame:
    return parse_wide(spark.read.text(path), keep, min_samples)


def to_local(df: DataFrame, key: str = "track_id") -> DataFrame:
    """Adds x, y: metres about the mean of the tracks' mean places."""
    centre = df.groupBy(key).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")).agg(F.avg("lat").alias("lat0"), F.avg("lon").alias("lon0"))
    x, y = local_metres(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0"))
    return df.crossJoin(F.broadcast(centre)).withColumn("x", x).withColumn("y", y).drop("lat0", "lon0")


def read_intersection(spark: SparkSession, path: str, keep: tuple[str, ...] | None = None) -> DataFrame:
    """(track_id, frame, t, x, y, speed) of a CSV with milliseconds and velocities."""
    schema = "track_id int, frame_id int, timestamp_ms double, agent_type string, x double, y double, vx double, vy double"
    rows = spark.read.option("header", True).schema(schema).csv(path)
    if keep:
        rows = rows.where(F.col("agent_type").isin(*keep))
    return rows.select("track_id", F.col("frame_id").alias("frame"), (F.col("timestamp_ms") / 1000).alias("t"), "x", "y", F.hypot("vx", "vy").alias("speed"))


def read_signals(spark: SparkSession, path: str, heads: list[str]) -> DataFrame:
    """(head, t, state) of a CSV with one column for each signal head."""
    rows = spark.read.option("header", True).csv(path)
    pairs = F.explode(F.array(*[F.struct(F.lit(h).alias("head"), F.col(f"`{h}`").try_cast("int").alias("state")) for h in heads]))
    return rows.select((F.col("`timestamp(ms)`").try_cast("double") / 1000).alias("t"), pairs.alias("p")).select("p.head", "t", "p.state")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Session ground truth with ``t``, seconds since its first clock time."""
    schema = "Local_Time string, Drone_ID int, Vehicle_ID int, Vehicle_Class int, Road_Section string, Vehicle_Speed double, Visibility int"
    rows = spark.read.option("header", True).schema(schema).csv(path).withColumn("s", clock_seconds(F.col("Local_Time")))
    first = rows.agg(F.min("s").alias("s0"))
    return rows.crossJoin(F.broadcast(first)).withColumn("t", F.col("s") - F.col("s0")).drop("s", "s0")


def headways(df: DataFrame, key: list[str], time: str = "t") -> DataFrame:
    """Adds ``headway``, the time to the next row of the key."""
    return df.withColumn("headway", F.lead(time).over(Window.partitionBy(*key).orderBy(time)) - F.col(time))
