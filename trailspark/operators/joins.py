"""As-of, interval, band and nearest joins, each as an equi-join, a window or a broadcast of literal geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspark.functions.geometry import segment_projection


def asof(left: DataFrame, right: DataFrame, by: str, time: str, value: str, forward: bool = False, strict: bool = False) -> DataFrame:
    """``left`` with the ``value`` of the latest row of ``right`` at or before its time (or the first at or after), null where none is.

    One exchange: both sides become one timeline per ``by``. At equal times a right row
    counts as before (after) unless ``strict``. Of right rows of one time the greatest value
    (forward: the least) is taken.
    """
    cols = left.columns
    side = 0 if forward == strict else 2
    mine = left.select(F.col(by).alias("__by"), F.col(time).alias("__t"), F.lit(1).alias("__side"), F.struct(*cols).alias("__row"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    theirs = right.select(F.col(by).alias("__by"), F.col(time).alias("__t"), F.lit(side).alias("__side"), F.lit(None).cast(mine.schema["__row"].dataType).alias("__row"), F.col(value).alias("__v"))
    w = Window.partitionBy("__by").orderBy("__t", "__side", "__v")
    found = F.first("__v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)) if forward else F.last("__v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return mine.unionByName(theirs).withColumn("__found", found).where(F.col("__row").isNotNull()).select("__row.*", F.col("__found").alias(f"asof_{value}"))


def within(points: DataFrame, intervals: DataFrame, by: list[str], time: str, start: str, end: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``points`` whose time lies in an interval of theirs, both ends included."""
    i = intervals.select(*[F.col(c).alias(f"__{c}") for c in by], F.col(start).alias("__a"), F.col(end).alias("__b"))
    on = F.col(time).between(F.col("__a"), F.col("__b"))
    for c in by:
        on = on & (F.col(c) == F.col(f"__{c}"))
    return points.join(i, on, how)


def band(left: DataFrame, right: DataFrame, l_time: str, r_time: str, before: float, after: float, width: float, by: list[str] = (), parts: int | None = None) -> DataFrame:
    """Pairs with r_time in [l_time - before, l_time + after]; names of the two sides must differ but for ``by``.

    Right rows are sent to the buckets of ``width`` that their partners can be in, so the
    join is one of equality however wide the table is. ``parts`` tasks join them if given,
    however small the two sides are.
    """
    r = right.withColumn("__b", F.explode(F.sequence(F.floor((F.col(r_time) - after) / width), F.floor((F.col(r_time) + before) / width))))
    l = left.withColumn("__b", F.floor(F.col(l_time) / width))  # noqa: E741
    l, r = (l, r) if parts is None else (d.repartition(parts, *by, "__b") for d in (l, r))  # noqa: E741
    return l.join(r, [*by, "__b"]).where(F.col(r_time).between(F.col(l_time) - before, F.col(l_time) + after)).drop("__b")


def segments_of(line: list[tuple[float, float]]) -> list[tuple[int, float, float, float, float, float]]:
    """(seg, ax, ay, bx, by, arc at a) of a literal polyline."""
    out, arc = [], 0.0
    for i, ((ax, ay), (bx, by)) in enumerate(zip(line, line[1:], strict=False)):
        out.append((i, float(ax), float(ay), float(bx), float(by), arc))
        arc += ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5
    return out


def station(x: Column, y: Column, line: list[tuple[float, float]]) -> Column:
    """Struct (d, seg, s, off) of the nearest place on a literal polyline: distance, segment, station and signed offset.

    The first segment wins ties; offset 0 counts as positive. Segments unroll into plain
    expressions, so there is no join.
    """
    found = []
    for seg, ax, ay, bx, by, arc in segments_of(line):
        part, fx, fy, d = segment_projection(x, y, ax, ay, bx, by)
        size = ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5
        side = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        found.append(F.struct(d.alias("d"), F.lit(seg).alias("seg"), (F.lit(arc) + part * size).alias("s"), F.when(side < 0, -d).otherwise(d).alias("off")))
    return F.array_min(F.array(*found))


def nearest_segment(points: DataFrame, segments: DataFrame, point_key: list[str], line_key: str = "line_id") -> DataFrame:
    """Points of each ``line_id`` with d, seg, s and off of their line's nearest segment, the segments in a (small, per-line) table."""
    part, fx, fy, d = segment_projection(*[F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")])
    side = (F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("x") - F.col("ax"))
    rows = points.join(segments, line_key).select(*point_key, line_key, F.struct(d.alias("d"), "seg", (F.col("arc0") + part * F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).alias("s"), F.when(side < 0, -d).otherwise(d).alias("off")).alias("p"))
    return rows.groupBy(*point_key, line_key).agg(F.min("p").alias("p")).select(*point_key, line_key, "p.*")


def nearest_vertex(x: Column, y: Column, vertices: list[tuple[float, float]]) -> Column:
    """Struct (d, v) of the nearest of some literal vertices, the first on ties."""
    return F.array_min(F.array(*[F.struct(F.hypot(x - px, y - py).alias("d"), F.lit(i).alias("v")) for i, (px, py) in enumerate(vertices)]))


def shared_ids(df: DataFrame, frame_a, frame_b, key: str = "track_id", frame: str = "frame") -> DataFrame:
    """Tracks seen in both of two frames."""
    return df.where(F.col(frame) == frame_a).select(key).join(df.where(F.col(frame) == frame_b).select(key), key, "left_semi").distinct()
