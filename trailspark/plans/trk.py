"""The trajectory view of the event table, and the register of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

LOW, HIGH = 20.0, 40.0  # speeds of stopping and moving in the event data

#: The same view in SQL.
TRK = """trk AS (
  SELECT user_id AS track_id, epoch_us(ts) / 1e6 AS t, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS k,
    value AS speed, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, event_type AS cls FROM events)"""


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track_id, t, k, speed, x, y, cls): one sample per event, k counting those of a track."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("track_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"),
        (F.row_number().over(w) - 1).cast("long").alias("k"),
        F.col("value").alias("speed"),
        F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("y"),
        F.col("event_type").alias("cls"),
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """``df`` with its doubles rounded, so that the order of summation doesn't show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
