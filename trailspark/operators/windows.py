"""Operators along a track. All use the same partitioning and order, so one exchange and one sort serve them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def along(key: str = "track_id", order: str = "k"):
    return Window.partitionBy(key).orderBy(order)


def steps(df: DataFrame, key: str = "track_id", order: str = "k") -> DataFrame:
    """Adds dx, dy, dt and step (their length) from the sample before; null at a track's first."""
    w = along(key, order)
    out = df.withColumns({f"d{c}": F.col(c) - F.lag(c).over(w) for c in ("x", "y", "t")})
    return out.withColumn("step", F.hypot("dx", "dy"))


def path_stats(df: DataFrame, key: str = "track_id", order: str = "k") -> DataFrame:
    """Per track: n, t0, t1, path (sum of steps), net displacement, reach (greatest distance from the first sample) and the trapezoid integral of speed."""
    w = along(key, order)
    rows = steps(df, key, order).withColumns({"sv": (F.col("speed") + F.lag("speed").over(w)) / 2 * F.col("dt"), "x0": F.first("x").over(w), "y0": F.first("y").over(w)})
    ends = lambda f: f(F.struct("x", "y"), order)
    out = rows.groupBy(key).agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("path"), ends(F.min_by).alias("a"), ends(F.max_by).alias("b"), F.max(F.hypot(F.col("x") - F.col("x0"), F.col("y") - F.col("y0"))).alias("reach"), F.coalesce(F.sum("sv"), F.lit(0.0)).alias("integral"))
    return out.select(key, "n", "t0", "t1", "path", F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")).alias("net"), "reach", "integral")


def cumulative_arc(df: DataFrame, key: str = "track_id", order: str = "k") -> DataFrame:
    """Adds ``arc``, the path length up to each sample."""
    w = along(key, order).rowsBetween(Window.unboundedPreceding, 0)
    return steps(df, key, order).withColumn("arc", F.sum(F.coalesce("step", F.lit(0.0))).over(w))


def rolling_median(value: str, seconds: float, key: str = "track_id", time: str = "t", floor: float | None = None) -> Column:
    """Median of the values within ``seconds`` before and after, both ends included."""
    # in SQL, as the Python form of a range takes whole numbers only
    out = F.expr(f"percentile({value}, 0.5) OVER (PARTITION BY {key} ORDER BY {time} RANGE BETWEEN {float(seconds)}D PRECEDING AND {float(seconds)}D FOLLOWING)")
    return out if floor is None else F.greatest(out, F.lit(floor))


def clip_spikes(df: DataFrame, value: str, seconds: float, band: float, key: str = "track_id", time: str = "t", min_finite: int = 5) -> DataFrame:
    """``value`` clipped to its rolling median plus or minus ``band`` where the track has ``min_finite`` values; nulls stay."""
    m = rolling_median(value, seconds, key, time)
    n = F.count(value).over(Window.partitionBy(key))
    clipped = F.greatest(m - band, F.least(m + band, F.col(value)))
    return df.withColumn(f"{value}_clipped", F.when(F.col(value).isNotNull() & (n >= min_finite), clipped).otherwise(F.col(value)))


def moving_average(value: str, width: int, key: str = "track_id", order: str = "k") -> Column:
    """Centred average of an odd number of samples; beyond a track's ends its first and last values are repeated."""
    half = width // 2
    w, all_rows = along(key, order), Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place, n = F.row_number().over(w) - 1, F.count("*").over(Window.partitionBy(key))
    short_left, short_right = F.greatest(F.lit(0), half - place), F.greatest(F.lit(0), half - (n - 1 - place))
    return (F.sum(value).over(w.rowsBetween(-half, half)) + short_left * F.first(value).over(all_rows) + short_right * F.last(value).over(all_rows)) / width


def box_filter(value: str, half: int = 3, key: str = "track_id", order: str = "k", valid_only: bool = False) -> Column:
    """Average of the samples within ``half`` where all of them exist; else the raw value, or null."""
    w = along(key, order).rowsBetween(-half, half)
    full = F.count(value).over(w) == 2 * half + 1
    return F.when(full, F.avg(value).over(w)).otherwise(F.lit(None) if valid_only else F.col(value))


def savgol_interior(value: str, key: str = "track_id", order: str = "k") -> Column:
    """Savitzky-Golay (7, 2) where seven samples exist; null at the three on either end (see kernels.savgol for those)."""
    w = along(key, order)
    # fixed values: the convolution weights of a quadratic over seven points
    weights = {-3: -2, -2: 3, -1: 6, 0: 7, 1: 6, 2: 3, 3: -2}
    parts = [(F.lag(value, -o) if o <= 0 else F.lead(value, o)).over(w) * weight for o, weight in weights.items()]
    return sum(parts[1:], parts[0]) / 21.0


def gradient(value: str, time: str = "t", key: str = "track_id", order: str = "k") -> Column:
    """Second-order central differences on uneven spacing, one-sided at the ends; null for a single sample."""
    w = along(key, order)
    v, t = F.col(value), F.col(time)
    v0, v1, t0, t1 = F.lag(value).over(w), F.lead(value).over(w), F.lag(time).over(w), F.lead(time).over(w)
    hd, hs = t - t0, t1 - t
    inner = F.try_divide(hd * hd * v1 + (hs * hs - hd * hd) * v - hs * hs * v0, hd * hs * (hd + hs))
    return F.when(v0.isNotNull() & v1.isNotNull(), inner).when(v1.isNotNull(), F.try_divide(v1 - v, hs)).otherwise(F.try_divide(v - v0, hd))


def gap_fill(df: DataFrame, values: list[str], key: str = "track_id", frame: str = "frame", max_gap: int | None = None) -> DataFrame:
    """One row for each frame between a track's first and last, missing ones interpolated; gaps over ``max_gap`` frames stay null.

    ``filled`` marks the new rows.
    """
    span = df.groupBy(key).agg(F.min(frame).alias("a"), F.max(frame).alias("b"))
    spine = span.select(key, F.explode(F.sequence("a", "b")).alias(frame))
    rows = spine.join(df.select(key, frame, *values).withColumn("__here", F.lit(True)), [key, frame], "left")
    w = along(key, frame)
    past, future = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    out = rows.withColumns({"__f0": F.last(F.when(F.col("__here"), F.col(frame)), ignorenulls=True).over(past), "__f1": F.first(F.when(F.col("__here"), F.col(frame)), ignorenulls=True).over(future)})
    part = F.try_divide(F.col(frame) - F.col("__f0"), F.col("__f1") - F.col("__f0"))
    for v in values:
        before, after = F.last(v, ignorenulls=True).over(past), F.first(v, ignorenulls=True).over(future)
        lerp = F.when(F.col("__f0") == F.col("__f1"), F.col(v)).otherwise(before + (after - before) * part)
        out = out.withColumn(f"__{v}", lerp if max_gap is None else F.when(F.col("__f1") - F.col("__f0") <= max_gap, lerp))
    return out.select(key, frame, *[F.col(f"__{v}").alias(v) for v in values], F.col("__here").isNull().alias("filled"))


def _legs(df: DataFrame, key: str, order: str) -> DataFrame:
    """The steps of each track as rows (key, order, x, y, arc, x1, y1, arc1, total): from a sample to the next."""
    w = along(key, order)
    rows = cumulative_arc(df, key, order)
    return rows.select(key, order, "x", "y", "arc", F.lead("arc").over(w).alias("arc1"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"), F.max("arc").over(Window.partitionBy(key)).alias("total"))


def _placed(legs: DataFrame, s) -> DataFrame:
    part = F.try_divide(s - F.col("arc"), F.col("arc1") - F.col("arc"))
    return legs.withColumns({"s": s, "x": F.col("x") + part * (F.col("x1") - F.col("x")), "y": F.col("y") + part * (F.col("y1") - F.col("y"))})


def resample_arc(df: DataFrame, points: int, key: str = "track_id", order: str = "k") -> DataFrame:
    """``points`` places at equal arc-length steps along each track: key, i, s, x, y. A track without length repeats its first place.

    Each leg makes only the places that lie on it, its start included and its end left to
    the next; the last place is the track's end.
    """
    rows = _legs(df, key, order)
    gap = F.col("total") / (points - 1)
    first, past = F.ceil(F.try_divide("arc", gap)).cast("int"), F.ceil(F.try_divide("arc1", gap)).cast("int")
    # rounding may put a place on either side of a sample, where both legs agree; the first and last are set
    spans = rows.where("arc1 > arc").withColumn("i", F.explode(F.filter(F.sequence(F.greatest(first - 1, F.lit(0)), F.least(past + 1, F.lit(points - 2))), lambda i: (i * F.col("total") / (points - 1) >= F.col("arc")) & (i * F.col("total") / (points - 1) < F.col("arc1")))))
    inner = _placed(spans, F.col("total") * F.col("i") / (points - 1)).select(key, "i", "s", "x", "y")
    last = rows.where("arc1 is null and total > 0").select(key, F.lit(points - 1).alias("i"), F.col("total").alias("s"), "x", "y")
    still = rows.where("total = 0 and arc1 is null").select(key, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"), F.col("total").alias("s"), "x", "y")
    return inner.unionByName(last).unionByName(still)


def resample_steps(df: DataFrame, step: float, key: str = "track_id", order: str = "k") -> DataFrame:
    """Places every ``step`` of the way along each track, from its start: key, i, x, y."""
    legs = _legs(df, key, order).where("arc1 > arc")
    first, past = F.ceil(F.col("arc") / step), F.ceil(F.col("arc1") / step)
    legs = legs.where(past > first).withColumn("i", F.explode(F.sequence(first, past - 1)))
    return _placed(legs, F.col("i") * step).select(key, "i", "x", "y")


def flip_headings(headings: DataFrame, samples: DataFrame, key: str = "track_id", order: str = "k") -> DataFrame:
    """``heading`` turned by half a circle where it differs by more than a right angle from the track's net motion."""
    ends = samples.groupBy(key).agg(F.min_by(F.struct("x", "y"), order).alias("a"), F.max_by(F.struct("x", "y"), order).alias("b"))
    net = ends.select(key, (F.col("b.x") - F.col("a.x")).alias("__nx"), (F.col("b.y") - F.col("a.y")).alias("__ny")).where("__nx <> 0 or __ny <> 0")
    gap = F.abs(F.col("heading") - F.atan2("__ny", "__nx"))
    away = F.coalesce(F.least(gap, 2 * math.pi - gap) > math.pi / 2, F.lit(False))
    turned = F.col("heading") + F.when(F.col("heading") > 0, -math.pi).otherwise(math.pi)
    return headings.join(net, key, "left").withColumn("heading", F.when(away, turned).otherwise(F.col("heading"))).drop("__nx", "__ny")


def heading_held(df: DataFrame, min_speed: float, key: str = "track_id", order: str = "k") -> DataFrame:
    """Adds ``heading`` (radians) of the step into each sample, held while the speed is below ``min_speed``."""
    w = along(key, order)
    raw = F.when((F.col("speed") >= min_speed) & (F.col("step") > 0), F.atan2("dy", "dx"))
    return steps(df, key, order).withColumn("heading", F.last(raw, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def circular_mean(angle: str, half: int, key: str = "track_id", order: str = "k") -> Column:
    """Average direction of the angles within ``half`` samples."""
    w = along(key, order).rowsBetween(-half, half)
    return F.atan2(F.avg(F.sin(angle)).over(w), F.avg(F.cos(angle)).over(w))


def total_turn(df: DataFrame, key: str = "track_id", order: str = "k") -> DataFrame:
    """Per track the summed absolute change of direction, each wrapped to at most pi."""
    w = along(key, order)
    way = steps(df, key, order).where("step > 0").withColumn("way", F.atan2("dy", "dx"))
    d = F.abs(F.col("way") - F.lag("way").over(w))
    return way.withColumn("turn", F.least(d, F.lit(2 * math.pi) - d)).groupBy(key).agg(F.coalesce(F.sum("turn"), F.lit(0.0)).alias("turn"))
