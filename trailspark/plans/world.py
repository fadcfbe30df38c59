"""Kinematics end to end: observations and per-frame homographies to smoothed tracks, state runs and stop events."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailspark.functions import geometry as g
from trailspark.operators import kernels, sequences, smoothing, windows
from trailspark.operators.lineage import python_workers, stored
from trailspark.params import Kinematics, Slip
from trailspark.plans import sql
from trailspark.plans.scene import HIDDEN, hidden_ids
from trailspark.plans.trk import HIGH, LOW, TRK, query, rounded, trk

H_COLS = [f"h{r}{c}" for r in (1, 2, 3) for c in (1, 2, 3)]


@dataclass(frozen=True)
class World:
    samples: DataFrame  # track_id, k, frame, t, x, y, speed, zv_mag
    runs: DataFrame  # track_id, run_no, stopped, f0, f1
    events: DataFrame  # track_id, frame, t, t_wav, x, y
    tracks: DataFrame  # track_id, n, path, net, static, zv_med_x, zv_med_y
    car_len: float
    field: DataFrame | None  # frame, a11, a12, a21, a22, b1, b2, spread of the slip


def lifted(observations: DataFrame, homographies: DataFrame) -> DataFrame:
    """Observations with world place (x, y) and local scale; frames without a homography drop out. The frame table is one clip's and small."""
    h = homographies.select(F.col("frame").alias("__f"), *H_COLS)
    rows = observations.join(h, F.col("frame") == F.col("__f"))
    m = [F.col(c) for c in H_COLS]
    x, y = g.project(m, F.col("cx"), F.col("cy"))
    return rows.withColumns({"x": x, "y": y, "jac": g.jacobian_scale(m, F.col("cx"), F.col("cy"))}).drop("__f", *H_COLS)


def car_length(rows: DataFrame, every: int = 5) -> float:
    """Median over every fifth observation of a track of its longer side in world units."""
    sampled = rows.withColumn("__n", F.row_number().over(Window.partitionBy("track_id").orderBy("frame")) - 1).where(F.col("__n") % every == 0)
    return sampled.agg(F.percentile(F.greatest("w", "h") * F.col("jac"), F.lit(0.5))).first()[0] or 1.0


def long_enough(rows: DataFrame, least: int, key: str = "track_id") -> DataFrame:
    return rows.withColumn("__n", F.count("*").over(Window.partitionBy(key))).where(F.col("__n") >= least).drop("__n")


def is_static(stats: DataFrame, car: float) -> DataFrame:
    """Lives 3 s or more, ends within 1.5 car lengths of its start and moves less than four in all."""
    return stats.withColumn("static", (F.col("t1") - F.col("t0") >= 3) & (F.col("net") < 1.5 * car) & (F.col("path") < 4 * car))


def flow_noise(flow: DataFrame, dt: float, ref_frame: bool, floor: float = Kinematics.flow_floor_px) -> DataFrame:
    """(track_id, frame, vx, vy, sv) of measured displacements (vx, vy, n, spread, jac).

    The noise is a floor or the standard error of the median displacement, over ``dt``. The
    local scale is divided out of chained homographies, whose errors it carries; those of a
    reference frame are trusted, and the scale only raises the floor.
    """
    jac = F.greatest(F.col("jac"), F.lit(1e-6))
    error = 1.858 * F.col("spread") / F.sqrt("n")
    if ref_frame:
        return flow.select("track_id", "frame", "vx", "vy", (F.greatest(floor * jac, error) / dt).alias("sv"))
    return flow.select("track_id", "frame", (F.col("vx") / jac).alias("vx"), (F.col("vy") / jac).alias("vy"), (F.greatest(F.lit(floor), error / jac) / dt).alias("sv"))


def parked_candidates(rows: DataFrame, car: float, fps: float, p: Kinematics = Kinematics()) -> DataFrame:
    """Tracks of enough samples that live 3 s or more and whose last places' median is within 1.5 car lengths of that of the first (nine of each, or half)."""
    w = windows.along("track_id", "frame")
    n = F.count("*").over(Window.partitionBy("track_id"))
    rows = rows.withColumns({"__i": F.row_number().over(w), "__n": n}).withColumn("__m", F.least(F.lit(9), F.floor(F.col("__n") / 2)))
    first, last = F.col("__i") <= F.col("__m"), F.col("__i") > F.col("__n") - F.col("__m")
    middle = lambda c, part: F.percentile(F.when(part, F.col(c)), F.lit(0.5))
    ends = rows.groupBy("track_id").agg(F.count("*").alias("n"), ((F.max("frame") - F.min("frame")) / fps).alias("life"), F.hypot(middle("x", last) - middle("x", first), middle("y", last) - middle("y", first)).alias("net"))
    return ends.where((F.col("n") >= p.min_frames) & (F.col("life") >= 3) & (F.col("net") < 1.5 * car)).select("track_id")


def slip_model(parked: DataFrame, flow: DataFrame, last_frame: int, pool: int, p: Slip = Slip()) -> DataFrame | None:
    """The slip field of each frame from the flow of ``parked`` samples (track_id, frame, x, y), gaps interpolated; None below ten fitted frames.

    Frames are those of one clip, so the field is a small table.
    """
    seen = parked.join(flow.select("track_id", "frame", "vx", "vy"), ["track_id", "frame"]).where(F.col("frame") < last_frame)
    fitted = stored(kernels.slip_field(seen, "frame", pool, p.min_pool))
    if fitted.count() < p.min_frames:
        return None
    names = ["a11", "a12", "a21", "a22", "b1", "b2", "spread"]
    return windows.gap_fill(fitted.withColumn("clip", F.lit(0)), names, "clip").select("frame", *names)


def slipped(rows: DataFrame, field: DataFrame, timescale: float, p: Slip = Slip()) -> DataFrame:
    """``rows`` (frame, x, y and perhaps vx, vy, sv) with the slip taken from the speeds, its spread added to their noise, and ``slip``, its share of the places' noise.

    Frames before the first of the field take its first, frames after the last its last.
    """
    low, high = field.agg(F.min("frame"), F.max("frame")).first()
    f = field.withColumnRenamed("frame", "__f")
    out = rows.join(f, F.greatest(F.lit(low), F.least(F.lit(high), F.col("frame"))) == F.col("__f"))
    sx = (F.col("a11") * F.col("x") + F.col("a12") * F.col("y")) / p.position_scale + F.col("b1")
    sy = (F.col("a21") * F.col("x") + F.col("a22") * F.col("y")) / p.position_scale + F.col("b2")
    out = out.withColumn("slip", F.hypot(sx, sy) * timescale)
    if "vx" in rows.columns:
        out = out.withColumns({"vx": F.col("vx") - sx, "vy": F.col("vy") - sy, "sv": F.hypot("sv", "spread")})
    return out.drop(*f.columns)


def _smooth(rows: DataFrame, car: float, p: Kinematics) -> DataFrame:
    """Both passes of the smoother, many tracks in one crossing to Python; ``zv_mag`` is the size of the measured velocity."""
    has_flow = "vx" in rows.columns
    cols = ["track_id", "frame", "t", "x", "y", "jac", "slip"] + (["vx", "vy", "sv"] if has_flow else [])

    def run(f: pd.DataFrame) -> pd.DataFrame:
        bounds = smoothing.bounds_of(f["track_id"])
        zv = f[["vx", "vy"]].to_numpy(dtype=float) if has_flow else None
        sv = f["sv"].fillna(1.0).to_numpy(dtype=float) if has_flow else None
        out = smoothing.smooth_tracks(bounds, f["t"].to_numpy(), f["x"], f["y"], car, f["jac"], zv, sv, f["slip"].to_numpy(), p.sigma_meas, p.sigma_jerk, p.gate)
        k = np.arange(len(f)) - np.repeat(bounds[:-1], np.diff(bounds))
        mag = np.hypot(zv[:, 0], zv[:, 1]) if has_flow else np.full(len(f), np.nan)
        return pd.DataFrame({"track_id": f["track_id"], "k": k, "frame": f["frame"], "t": f["t"], "x": out.x, "y": out.y, "speed": out.speed, "zv_mag": mag})

    kinds = dict(rows.dtypes)
    out = smoothing.whole_groups(rows.select(*cols), "track_id", ["frame"], run, f"track_id {kinds['track_id']}, k long, frame {kinds['frame']}, t double, x double, y double, speed double, zv_mag double")
    return out.withColumn("zv_mag", F.nanvl("zv_mag", F.lit(None).cast("double")))


def world(observations: DataFrame, homographies: DataFrame, fps: float, flow: DataFrame | None = None, p: Kinematics = Kinematics(), ref_frame: bool = False, flow_dt: float | None = None) -> World:
    """All tables of the stage.

    ``flow`` (track_id, frame, vx, vy, n, spread, jac; measured over ``flow_dt`` seconds, one
    frame by default) is fused where given: its noise is modelled, the slip that parked
    tracks show is taken off, spikes are clipped, and the smoother weighs what is left.
    """
    places = lifted(observations, homographies)
    rows = long_enough(places, p.min_frames)
    car = car_length(rows)
    rows = long_enough(sequences.screen_jumps(rows, p.jump * car), p.min_frames).withColumn("t", F.col("frame") / F.lit(float(fps))).withColumn("slip", F.lit(0.0))
    field = None
    if flow is not None:
        speeds = stored(flow_noise(flow, flow_dt or 1.0 / fps, ref_frame, p.flow_floor_px))
        last = homographies.agg(F.max("frame")).first()[0] or 0
        parked = places.join(parked_candidates(places, car, fps, p), "track_id", "left_semi").select("track_id", "frame", "x", "y")
        field = slip_model(parked, speeds, last, 0 if ref_frame else Slip.pool)
        rows = rows.join(speeds, ["track_id", "frame"], "left")
        if field is not None:
            rows = slipped(rows.drop("slip"), field, 1.0 / fps if ref_frame else p.slip_s)
        band = p.accel * car * p.spike_window_s + 0.3 * car
        for axis in ("vx", "vy"):
            rows = windows.clip_spikes(rows, axis, p.spike_window_s, band).withColumn(axis, F.col(f"{axis}_clipped")).drop(f"{axis}_clipped")
    rows = stored(rows)
    samples = stored(_smooth(rows, car, p))
    marked = samples.withColumn("stopped", sequences.hysteresis("speed", p.v_stop * car, p.v_move * car))
    runs = stored(sequences.state_runs(marked, "stopped", max(1, int(p.min_run_s * fps)), order="frame"))
    onsets = stored(sequences.stop_onsets(samples, runs, p.v_stop * car, 2 * car, 0.8, order="frame"))
    waves = kernels.wavelet_onsets(samples, onsets, fps, order="frame")
    events = onsets.join(waves, ["track_id", "frame"]).withColumn("t_wav", F.coalesce("t_wav", "t"))
    tracks = is_static(windows.path_stats(samples), car)
    if flow is not None:
        seen = rows.where("vx is not null").groupBy("track_id").agg(F.count("*").alias("__n"), F.percentile("vx", F.lit(0.5)).alias("zv_med_x"), F.percentile("vy", F.lit(0.5)).alias("zv_med_y"))
        tracks = tracks.join(seen.where(F.col("__n") >= 10), "track_id", "left")
    else:
        tracks = tracks.withColumns({"zv_med_x": F.lit(None).cast("double"), "zv_med_y": F.lit(None).cast("double")})
    return World(samples, runs, events, tracks.select("track_id", "n", "path", "net", "static", "zv_med_x", "zv_med_y"), car, field)


def manual_world(points: DataFrame, homographies: DataFrame, fps: float) -> DataFrame:
    """Hand-made key points to dense samples: interpolated frames, lifted, smoothed by a seven-point box, with speed."""
    dense = windows.gap_fill(points, ["x", "y"]).select("track_id", "frame", F.col("x").alias("cx"), F.col("y").alias("cy"))
    rows = lifted(dense, homographies).withColumn("t", F.col("frame") / F.lit(float(fps)))
    rows = rows.select("track_id", "frame", "t", windows.box_filter("x", order="frame").alias("x"), windows.box_filter("y", order="frame").alias("y"))
    return rows.withColumn("speed", F.hypot(windows.gradient("x", order="frame"), windows.gradient("y", order="frame")))


def displayed_states(samples: DataFrame, overrides: DataFrame, fps: float, v_stop: float, v_move: float, hold_s: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Quantised states with the overrides pinned, and the stop commits that count."""
    states = sequences.three_states(samples.select("track_id", "k", "speed"), v_stop, v_move, max(1, int(hold_s * fps)))
    pinned = sequences.pin_overrides(states.select("track_id", "k", "state"), overrides)
    return pinned, sequences.rearmed_commits(pinned).select("track_id", "k")


def backfill(samples: DataFrame, focus: DataFrame, car: float, v_stop: float, near: float = 0.65, limits: DataFrame | None = None) -> DataFrame:
    """New rows (clip, track_id, frame, x, y) of focus cars that stand at their first frame, back to frame 0, to another car's place, or to ``limits``.

    Cars are taken in the order of their first frame, and later ones see what was filled for
    earlier ones, so a ``clip`` (one for all, if there is no such column) is one group.
    ``limits`` (track_id, stop) names the last frame that a car can't be filled at, see
    :func:`out_of_frame`.
    """
    python_workers(samples.sparkSession)
    rows = samples if "clip" in samples.columns else samples.withColumn("clip", F.lit(0))
    rows = rows.join(focus.select("track_id"), "track_id", "left_semi")
    rows = rows.join(limits, "track_id", "left") if limits is not None else rows.withColumn("stop", F.lit(-1))
    rows = rows.withColumn("stop", F.coalesce("stop", F.lit(-1)).cast("long"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["track_id", "frame"])
        seen = {fr: g[["track_id", "x", "y"]].to_numpy(dtype=float) for fr, g in f.groupby("frame")}
        first = f.groupby("track_id").head(10).groupby("track_id").agg(frame=("frame", "first"), x=("x", "first"), y=("y", "first"), speed=("speed", "median"), stop=("stop", "first")).reset_index().sort_values(["frame", "track_id"])
        filled: list[tuple[int, int, float, float]] = []  # first and last frame, place
        out = []
        for car_id, f0, x, y, speed, stop in first.itertuples(index=False):
            if f0 <= 0 or speed > 1.5 * v_stop or car_id < 0:
                continue
            close = lambda px, py: np.hypot(px - x, py - y) < near * car  # noqa: B023, E731
            low = max([stop + 1, *(b + 1 for a, b, px, py in filled if a < f0 and close(px, py))])
            at = int(f0) - 1
            while at >= max(low, 0) and not (at in seen and close(seen[at][:, 1], seen[at][:, 2]).any()):
                out.append((car_id, at, x, y))
                at -= 1
            if at < f0 - 1:
                filled.append((at + 1, int(f0) - 1, x, y))
        return pd.DataFrame(out, columns=["track_id", "frame", "x", "y"]).assign(clip=f["clip"].iloc[0])[["clip", "track_id", "frame", "x", "y"]]

    kinds = dict(rows.dtypes)
    return rows.select("clip", "track_id", "frame", "x", "y", "speed", "stop").groupBy("clip").applyInPandas(run, f"clip {kinds['clip']}, track_id {kinds['track_id']}, frame {kinds['frame']}, x double, y double")


def out_of_frame(samples: DataFrame, homographies: DataFrame, width: int, height: int, margin: float = 40.0) -> DataFrame:
    """(track_id, stop): the last frame before a track's first at which its first place, seen through that frame's inverse homography, leaves the picture by more than ``margin``.

    The picture place is shifted so that it meets the detected one (cx, cy), where given, at the first frame.
    """
    cols = ["frame", "x", "y"] + (["cx", "cy"] if "cx" in samples.columns else [])
    first = samples.groupBy("track_id").agg(F.min_by(F.struct(*cols), "frame").alias("p")).select("track_id", *[F.col(f"p.{c}").alias("f0" if c == "frame" else c) for c in cols])
    h = homographies.select(F.col("frame").alias("__f"), *H_COLS)
    back = lambda: g.project(g.inverse([F.col(c) for c in H_COLS]), F.col("x"), F.col("y"))
    u, v = back()
    if "cx" in cols:
        own = first.join(h, F.col("f0") == F.col("__f"), "left").select(*first.columns, F.coalesce(F.col("cx") - u, F.lit(0.0)).alias("du"), F.coalesce(F.col("cy") - v, F.lit(0.0)).alias("dv"))
    else:
        own = first.withColumns({"du": F.lit(0.0), "dv": F.lit(0.0)})
    every = own.withColumn("__f", F.explode(F.when(F.col("f0") > 0, F.sequence(F.lit(0).cast("long"), F.col("f0").cast("long") - 1)))).join(h, "__f")
    u, v = back()
    inside = (u + F.col("du")).between(-margin, width + margin) & (v + F.col("dv")).between(-margin, height + margin)
    return every.where(~inside).groupBy("track_id").agg(F.max("__f").alias("stop"))


def parked_flow(samples: DataFrame, parked: DataFrame) -> DataFrame:
    """Medians over the ``parked`` tracks of their medians: raw speed, speed without the slip (bx, by), and the size of the median velocity without it."""
    middle = lambda c: F.percentile(c, F.lit(0.5))
    cx, cy = F.col("vx") - F.col("bx"), F.col("vy") - F.col("by")
    per = samples.join(parked.select("track_id"), "track_id", "left_semi").groupBy("track_id").agg(middle(F.hypot("vx", "vy")).alias("raw"), middle(F.hypot(cx, cy)).alias("corrected"), F.hypot(middle(cx), middle(cy)).alias("bias"))
    return per.agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in ("raw", "corrected", "bias")], F.count("*").alias("n"))


def key_frames(frames: DataFrame, max_frames: int, max_shift: float, key: str = "clip") -> DataFrame:
    """Frames (clip, frame, score, shift) cut into windows that close after ``max_frames`` or a summed shift of ``max_shift``; the sharpest of each."""
    python_workers(frames.sparkSession)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("frame")
        out, begin, gone = [], 0, 0.0
        shift = f["shift"].to_numpy(dtype=float)
        for i in range(len(f)):
            gone += shift[i]
            if i - begin + 1 >= max_frames or gone >= max_shift or i == len(f) - 1:
                window = f.iloc[begin : i + 1]
                out.append(window.iloc[int(np.argmax(window["score"].to_numpy()))])
                begin, gone = i + 1, 0.0
        return pd.DataFrame(out, columns=f.columns)

    return frames.groupBy(key).applyInPandas(run, frames.schema)


def nearest_keyframe(frames: DataFrame, keys: list[int]) -> DataFrame:
    """``frames`` with the nearest key frame, the earlier on ties."""
    best = F.array_min(F.array(*[F.struct(F.abs(F.col("frame") - k).alias("d"), F.lit(k).alias("k")) for k in sorted(keys)]))
    return frames.withColumn("keyframe", best["k"])


def tile_grid(width: int, height: int, nx: int, ny: int, overlap: float) -> list[tuple[int, int, int, int]]:
    """Overlapping tiles (x0, y0, x1, y1) that cover a frame."""
    out = []
    for j in range(ny):
        for i in range(nx):
            w, h = width / nx, height / ny
            out.append((max(0, round(i * w - overlap * w / 2)), max(0, round(j * h - overlap * h / 2)), min(width, round((i + 1) * w + overlap * w / 2)), min(height, round((j + 1) * h + overlap * h / 2))))
    return out


def merged_tiles(detections: DataFrame, max_det: int, iou: float = 0.5) -> DataFrame:
    """Detections (frame, cls, cx, cy, w, h, conf) of overlapping tiles, one per object, the ``max_det`` most confident of each frame."""
    python_workers(detections.sparkSession)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["conf", "cx", "cy"], ascending=[False, True, True], kind="stable")
        keep = kernels.nms(f[["cx", "cy", "w", "h"]].to_numpy(dtype=float), f["conf"].to_numpy(dtype=float), f["cls"].to_numpy(), iou)
        return f.iloc[keep[:max_det]]

    return detections.groupBy("frame").applyInPandas(run, detections.schema)


def offset_line(vertices: DataFrame, offset: float, key: str = "line_id", order: str = "v") -> DataFrame:
    """Polylines moved sideways by ``offset`` along their normals."""
    w = windows.along(key, order)
    tx = F.coalesce(F.lead("x").over(w), F.col("x")) - F.coalesce(F.lag("x").over(w), F.col("x"))
    ty = F.coalesce(F.lead("y").over(w), F.col("y")) - F.coalesce(F.lag("y").over(w), F.col("y"))
    rows = vertices.withColumns({"__tx": tx, "__ty": ty}).withColumn("__n", F.hypot("__tx", "__ty"))
    return rows.select(key, order, (F.col("x") - F.try_divide(F.col("__ty"), F.col("__n")) * offset).alias("x"), (F.col("y") + F.try_divide(F.col("__tx"), F.col("__n")) * offset).alias("y"))


def editor_payload(samples: DataFrame, states: DataFrame, hide: DataFrame) -> DataFrame:
    """One JSON document for each shown track: its frames, rounded places and a string of state letters."""
    rows = samples.where("track_id >= 0").join(hide.select("track_id"), "track_id", "left_anti").join(states.select("track_id", "k", "state"), ["track_id", "k"])
    rows = rows.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("k", F.round("x", 1).alias("x"), F.round("y", 1).alias("y"), F.substring("state", 1, 1).alias("s")))).alias("p"))
    return rows.select("track_id", F.to_json(F.struct("track_id", F.col("p.k").alias("frames"), F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.array_join("p.s", "").alias("states"))).alias("payload"))


_PINNED = """ov(track_id, frame, st) AS (VALUES (3, 10, 'stopped'), (6, 20, 'rolling'), (6, 22, 'braking'), (9, 0, 'stopped')),
pc AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY track_id ORDER BY k) = state THEN NULL ELSE k END AS ch FROM q3), pg AS (SELECT *, max(ch) OVER (PARTITION BY track_id ORDER BY k) AS seg FROM pc),
pa AS (SELECT ov.track_id, ov.frame, ov.st, min(pg.k) AS a, arg_min(pg.seg, pg.k) AS pseg FROM ov JOIN pg ON pg.track_id = ov.track_id AND pg.k >= ov.frame GROUP BY 1, 2, 3),
pinned AS (SELECT pg.track_id, pg.k, coalesce(arg_max(pa.st, pa.frame), any_value(pg.state)) AS state FROM pg LEFT JOIN pa ON pa.track_id = pg.track_id AND pa.pseg = pg.seg AND pg.k >= pa.a GROUP BY pg.track_id, pg.k)"""
#: The observations of :func:`observed` in SQL, and their places under the homographies.
OBSERVED = f"""{TRK},
ob AS (SELECT track_id, cls, k, k AS frame, sum(CASE WHEN k % 40 < 24 THEN 4 + (track_id % 5) * 0.5 ELSE 0.0 END) OVER (PARTITION BY track_id ORDER BY k)::DOUBLE + y / 200 AS cx, 5.0 * (track_id % 7) + y / 300 AS cy, y FROM trk),
li AS (SELECT track_id, k, frame, frame / 5 AS t, cx + 2 AS x, cy - 1 AS y, 1.0::DOUBLE AS jac FROM ob WHERE frame < 60)"""
WORLD = f"""{OBSERVED}, zs AS (SELECT * FROM li WHERE track_id IN (SELECT track_id FROM li GROUP BY track_id HAVING count(*) >= 12)), {sql.smoother('zs', 'sm', 30.0)}"""
EVENTS = f"""{WORLD}, {sql.hysteresis('sm', 'hy', 3.0, 6.6)}, {sql.absorbed('hy', 'ab', 2)}, {sql.onsets('sm', 'ab', 'onset', 3.0, 60.0, 0.8)}"""


def observed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The tracks as observations of cars that drive for 24 frames and stand for 16, and a homography for each of the first 60 frames."""
    df = trk(spark, sf_dir)
    gone = F.sum(F.when(F.col("k") % 40 < 24, 4 + F.col("track_id") % 5 * 0.5).otherwise(0.0)).over(windows.along().rowsBetween(Window.unboundedPreceding, 0))
    df = df.select("track_id", "cls", F.col("k").alias("frame"), (gone + F.col("y") / 200).alias("cx"), (5.0 * (F.col("track_id") % 7) + F.col("y") / 300).alias("cy"), F.lit(30.0).alias("w"), F.lit(15.0).alias("h"), F.lit(0.9).alias("conf"), "y")
    h = spark.range(60).select(F.col("id").alias("frame"), *[F.lit(v).alias(c) for c, v in zip(H_COLS, (1.0, 0.0, 2.0, 0.0, 1.0, -1.0, 0.0, 0.0, 1.0), strict=True)])
    return df, h


@query(f"WITH {OBSERVED} SELECT track_id, frame, round(x, 6) AS x, round(y, 6) AS y, jac FROM li")
def lifted_places(spark, sf_dir):
    """Observations under their frame's homography; those beyond the last one drop out."""
    obs, h = observed(spark, sf_dir)
    return rounded(lifted(obs.drop("y"), h).select("track_id", "frame", "x", "y", "jac"))


@query(f"WITH {TRK} SELECT track_id, k FROM trk WHERE track_id IN (SELECT track_id FROM trk GROUP BY track_id HAVING count(*) >= 70)")
def long_tracks(spark, sf_dir):
    return long_enough(trk(spark, sf_dir), 70).select("track_id", "k")


@query(f"WITH {TRK} SELECT round(quantile_cont(greatest(20 + y / 10, 24.0), 0.5), 6) AS car FROM trk WHERE k % 5 = 0")
def car_scale(spark, sf_dir):
    """The car length of boxes of changing width, every fifth of a track counting."""
    rows = trk(spark, sf_dir).select("track_id", F.col("k").alias("frame"), (20 + F.col("y") / 10).alias("w"), F.lit(24.0).alias("h"), F.lit(1.0).alias("jac"))
    return spark.createDataFrame([(round(car_length(rows), 6),)], "car double")


@query(f"WITH RECURSIVE {WORLD} SELECT track_id, k, k AS frame, round(t, 3) AS t, round(x, 3) AS x, round(y, 3) AS y, round(speed, 3) AS speed FROM sm")
def world_samples(spark, sf_dir):
    obs, h = observed(spark, sf_dir)
    return rounded(world(obs.drop("y"), h, 5.0).samples.drop("zv_mag"), 3)


@query(f"WITH RECURSIVE {EVENTS}, {sql.wavelets('sm', 'onset', 'wv', 5.0)} SELECT track_id, frame, round(t, 3) AS t, round(coalesce(t_wav, t), 3) AS t_wav, round(x, 3) AS x, round(y, 3) AS y FROM onset LEFT JOIN wv USING (track_id, frame)")
def world_events(spark, sf_dir):
    obs, h = observed(spark, sf_dir)
    return rounded(world(obs.drop("y"), h, 5.0).events, 3)


@query(f"WITH RECURSIVE {EVENTS} SELECT * FROM ab")
def world_runs(spark, sf_dir):
    obs, h = observed(spark, sf_dir)
    return world(obs.drop("y"), h, 5.0).runs


#: Measured displacements: y stands for their noise; those of three of four samples of two of three tracks are there.
FLOW = f"{OBSERVED}, fl AS (SELECT track_id, k AS frame, 10 + (y - 50) / 10 AS vx, -4 + (y - 50) / 20 AS vy, 4 + k % 5 AS n, y / 100 AS spread, 1 + y / 200 AS jac FROM trk WHERE k % 4 <> 3 AND track_id % 3 <> 2)"


def measured(spark, sf_dir) -> DataFrame:
    y = F.col("y")
    return trk(spark, sf_dir).where("k % 4 <> 3 and track_id % 3 <> 2").select("track_id", F.col("k").alias("frame"), (10 + (y - 50) / 10).alias("vx"), (-4 + (y - 50) / 20).alias("vy"), (4 + F.col("k") % 5).alias("n"), (y / 100).alias("spread"), (1 + y / 200).alias("jac"))


_NOISE = "SELECT track_id, frame, {v}, round(greatest({floor}, {error}) / 0.04, 6) AS sv FROM fl"


@query(
    f"WITH {FLOW} SELECT 'chained' AS way, track_id, frame, round(vx / jac, 6) AS vx, round(vy / jac, 6) AS vy, round(greatest(0.4, 1.858 * spread / sqrt(n) / jac) / 0.04, 6) AS sv FROM fl "
    "UNION ALL SELECT 'reference', track_id, frame, round(vx, 6), round(vy, 6), round(greatest(0.4 * jac, 1.858 * spread / sqrt(n)) / 0.04, 6) FROM fl"
)
def flow_velocities(spark, sf_dir):
    """The noise model of measured velocities, for chained homographies and for those of a reference frame."""
    fl = measured(spark, sf_dir)
    both = [flow_noise(fl, 0.04, ref).withColumn("way", F.lit(name)) for name, ref in (("chained", False), ("reference", True))]
    return rounded(both[0].unionByName(both[1]))


@query(f"WITH {FLOW} SELECT li.track_id, li.frame, round(x, 6) AS x, round(vx / fl.jac, 6) AS vx FROM li LEFT JOIN fl ON fl.track_id = li.track_id AND fl.frame = li.frame")
def flow_on_samples(spark, sf_dir):
    """Samples with their measured velocity, null where none is."""
    obs, h = observed(spark, sf_dir)
    rows = lifted(obs.drop("y"), h).select("track_id", "frame", "x")
    return rounded(rows.join(flow_noise(measured(spark, sf_dir), 0.04, False).drop("vy", "sv"), ["track_id", "frame"], "left"))


PARKED = f"""{FLOW}, nn AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY track_id) AS n FROM (SELECT track_id, k AS frame, 300 + y / 5 AS x, y / 3 AS y FROM trk) WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
pc AS (SELECT track_id FROM nn GROUP BY track_id, n HAVING n >= 12 AND (max(frame) - min(frame)) / 20.0 >= 3 AND sqrt(power(quantile_cont(x, 0.5) FILTER (i > n - least(9, n // 2)) - quantile_cont(x, 0.5) FILTER (i <= least(9, n // 2)), 2)
  + power(quantile_cont(y, 0.5) FILTER (i > n - least(9, n // 2)) - quantile_cont(y, 0.5) FILTER (i <= least(9, n // 2)), 2)) < 15)"""


def _still(spark, sf_dir) -> DataFrame:
    return trk(spark, sf_dir).select("track_id", F.col("k").alias("frame"), (300 + F.col("y") / 5).alias("x"), (F.col("y") / 3).alias("y"))


@query(f"WITH {PARKED} SELECT nn.track_id, nn.frame, round(nn.x, 6) AS x, round(nn.y, 6) AS y, round(fl.vx, 6) AS vx, round(fl.vy, 6) AS vy FROM nn JOIN pc USING (track_id) JOIN fl ON fl.track_id = nn.track_id AND fl.frame = nn.frame")
def parked_velocities(spark, sf_dir):
    """Samples of parked tracks with their measured velocity: what the slip field is fitted on."""
    still = _still(spark, sf_dir)
    rows = still.join(parked_candidates(still, 10.0, 20.0), "track_id", "left_semi")
    return rounded(rows.join(measured(spark, sf_dir).select("track_id", "frame", "vx", "vy"), ["track_id", "frame"]))


_SLIP = [(f, 0.5 + f / 97.3, -0.2, 0.1, 0.3 - f / 211, 1.0 + f / 7.3, -2.013, 0.25 + f / 400) for f in range(5, 40)]
_SLIP_SQL = ", ".join("(" + ", ".join(str(v) if i == 0 else f"{v!r}::DOUBLE" for i, v in enumerate(r)) + ")" for r in _SLIP)


@query(
    f"""WITH {FLOW}, sf(f, a11, a12, a21, a22, b1, b2, sp) AS (VALUES {_SLIP_SQL}),
s AS (SELECT li.track_id, li.frame, fl.vx, fl.vy, (a11 * li.x + a12 * li.y) / 1000 + b1 AS sx, (a21 * li.x + a22 * li.y) / 1000 + b2 AS sy, sp FROM li JOIN fl ON fl.track_id = li.track_id AND fl.frame = li.frame JOIN sf ON sf.f = greatest(5, least(39, li.frame)))
SELECT track_id, frame, round(vx - sx, 4) AS vx, round(vy - sy, 4) AS vy, round(sqrt(1 + sp * sp), 4) AS sv, round(0.5 * sqrt(sx * sx + sy * sy), 4) AS slip FROM s"""
)
def slip_taken_off(spark, sf_dir):
    """Velocities without the slip of their frame's field; frames beyond its ends take the nearest."""
    obs, h = observed(spark, sf_dir)
    field = spark.createDataFrame(_SLIP, "frame long, a11 double, a12 double, a21 double, a22 double, b1 double, b2 double, spread double")
    rows = lifted(obs.drop("y"), h).select("track_id", "frame", "x", "y").join(measured(spark, sf_dir).select("track_id", "frame", "vx", "vy", F.lit(1.0).alias("sv")), ["track_id", "frame"])
    return rounded(slipped(rows, field, 0.5).select("track_id", "frame", "vx", "vy", "sv", "slip"), 4)


@query(
    f"""WITH {PARKED}, s AS (SELECT nn.track_id, fl.vx, fl.vy, fl.vx - 9 AS cx, fl.vy + 3 AS cy FROM nn JOIN pc USING (track_id) JOIN fl ON fl.track_id = nn.track_id AND fl.frame = nn.frame),
t AS (SELECT track_id, quantile_cont(sqrt(vx * vx + vy * vy), 0.5) AS raw, quantile_cont(sqrt(cx * cx + cy * cy), 0.5) AS corrected, sqrt(power(quantile_cont(cx, 0.5), 2) + power(quantile_cont(cy, 0.5), 2)) AS bias FROM s GROUP BY track_id)
SELECT round(quantile_cont(raw, 0.5), 6) AS raw, round(quantile_cont(corrected, 0.5), 6) AS corrected, round(quantile_cont(bias, 0.5), 6) AS bias, count(*) AS n FROM t"""
)
def parked_speeds(spark, sf_dir):
    """Medians over parked tracks of the measured speed, the speed without slip, and the velocity that stays."""
    still = _still(spark, sf_dir)
    rows = still.join(measured(spark, sf_dir).select("track_id", "frame", "vx", "vy"), ["track_id", "frame"])
    rows = rows.withColumns({"bx": F.lit(9.0), "by": F.lit(-3.0)})
    return rounded(parked_flow(rows, parked_candidates(still, 10.0, 20.0)))


@query(f"WITH RECURSIVE {TRK}, {sql.three_states('trk', 'q3', LOW, HIGH, 5)}, {_PINNED} SELECT track_id, k, state FROM pinned")
def displayed(spark, sf_dir):
    """The quantised states with overrides pinned until their next change."""
    pins = spark.createDataFrame([(3, 10, "stopped"), (6, 20, "rolling"), (6, 22, "braking"), (9, 0, "stopped")], "track_id long, frame long, state string")
    return displayed_states(trk(spark, sf_dir), pins, 25.0, LOW, HIGH)[0]


@query(f"WITH RECURSIVE {TRK}, {sql.three_states('trk', 'q3', LOW, HIGH, 5)}, {_PINNED}, cm AS (SELECT *, lag(state) OVER w AS b, sum(CASE WHEN state = 'rolling' THEN 1 ELSE 0 END) OVER w AS r FROM pinned WINDOW w AS (PARTITION BY track_id ORDER BY k)), mm AS (SELECT track_id, k, r, lag(r) OVER (PARTITION BY track_id ORDER BY k) AS pr FROM cm WHERE state = 'stopped' AND b <> 'stopped') SELECT track_id, k FROM mm WHERE r > coalesce(pr, 0)")
def displayed_onsets(spark, sf_dir):
    """The stop commits of the displayed states that count: a car has rolled since its last one."""
    pins = spark.createDataFrame([(3, 10, "stopped"), (6, 20, "rolling"), (6, 22, "braking"), (9, 0, "stopped")], "track_id long, frame long, state string")
    return displayed_states(trk(spark, sf_dir), pins, 25.0, LOW, HIGH)[1]


@query(
    f"""WITH {HIDDEN}, p AS (SELECT track_id, list({{'k': k, 'x': round(x, 1), 'y': round(y, 1), 's': CASE WHEN speed < 20 THEN 's' ELSE 'r' END}} ORDER BY k) AS p FROM trk WHERE track_id >= 0 AND track_id NOT IN (SELECT track_id FROM hid) GROUP BY track_id)
SELECT track_id, list_transform(p, lambda v: v.k) AS frames, list_transform(p, lambda v: v.x) AS x, list_transform(p, lambda v: v.y) AS y, array_to_string(list_transform(p, lambda v: v.s), '') AS states FROM p"""
)
def editor_documents(spark, sf_dir):
    """The editor's documents, parsed again, so that the text's own form of numbers doesn't show."""
    df = trk(spark, sf_dir)
    states = df.select("track_id", "k", F.when(F.col("speed") < 20, "stopped").otherwise("rolling").alias("state"))
    docs = editor_payload(df, states, hidden_ids(spark, sf_dir))
    return docs.select(F.from_json("payload", "track_id long, frames array<long>, x array<double>, y array<double>, states string").alias("d")).select("d.*")


#: Cars in rows of twenty places, entering at different frames; a quarter of them moves.
_QUEUED = f"{TRK}, qc AS (SELECT track_id, k + track_id % 13 AS frame, 8.0 * (track_id % 20) + y / 100 AS x, 30.0 * (track_id % 2) AS y, CASE WHEN track_id % 4 = 0 THEN 9.0 ELSE 0.5 END AS speed FROM trk)"


def _queued_cars(spark, sf_dir) -> DataFrame:
    i = F.col("track_id")
    return trk(spark, sf_dir).select("track_id", (F.col("k") + i % 13).alias("frame"), (8.0 * (i % 20) + F.col("y") / 100).alias("x"), (30.0 * (i % 2)).alias("y"), F.when(i % 4 == 0, 9.0).otherwise(0.5).alias("speed"))


@query(
    f"""WITH RECURSIVE {_QUEUED}, ft AS (SELECT track_id, min(frame) AS f0, arg_min(x, frame) AS x, arg_min(y, frame) AS y, any_value(speed) AS v FROM qc GROUP BY track_id),
ok AS (SELECT *, row_number() OVER (ORDER BY f0, track_id) AS n FROM ft WHERE f0 > 0 AND v <= 1.5 AND track_id >= 0),
re AS (SELECT ok.n, coalesce(max(qc.frame) + 1, 0) AS low FROM ok LEFT JOIN qc ON qc.frame < ok.f0 AND sqrt(power(qc.x - ok.x, 2) + power(qc.y - ok.y, 2)) < 0.65 * 10 GROUP BY ok.n),
ou AS (SELECT n, max(f) AS stop FROM ok, range(13) r(f) WHERE f < f0 AND NOT (x - 6 * f BETWEEN -40 AND 140) GROUP BY n),
ls AS (SELECT ok.*, greatest(low, coalesce(stop + 1, 0)) AS low FROM ok JOIN re USING (n) LEFT JOIN ou USING (n)),
bf AS (
  SELECT 0::BIGINT AS n, 0::BIGINT AS track_id, 0::BIGINT AS a, -1::BIGINT AS b, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, []::STRUCT(a BIGINT, b BIGINT, x DOUBLE, y DOUBLE)[] AS done
  UNION ALL
  SELECT n, track_id, a, b, x, y, CASE WHEN a <= b THEN list_append(done, {{'a': a, 'b': b, 'x': x, 'y': y}}) ELSE done END FROM (
    SELECT l.n, l.track_id, greatest(l.low, coalesce(list_max(list_transform(list_filter(bf.done, lambda d: d.a < l.f0 AND sqrt(power(d.x - l.x, 2) + power(d.y - l.y, 2)) < 0.65 * 10), lambda d: d.b + 1)), 0))::BIGINT AS a, (l.f0 - 1)::BIGINT AS b, l.x, l.y, bf.done FROM bf JOIN ls l ON l.n = bf.n + 1))
SELECT track_id, unnest(range(a, b + 1)) AS frame, round(x, 6) AS x, y FROM bf WHERE a <= b"""
)
def backfilled(spark, sf_dir):
    """Frames filled for standing cars before they were detected; the picture moves, so that some leave it."""
    cars = _queued_cars(spark, sf_dir)
    shift = {"h13": -6.0 * F.col("frame")}
    eye = {"h11": 1.0, "h12": 0.0, "h21": 0.0, "h22": 1.0, "h23": 0.0, "h31": 0.0, "h32": 0.0, "h33": 1.0}
    # the inverse of a shift by +6 a frame moves places by -6
    h = spark.range(13).select(F.col("id").alias("frame")).withColumns({**{k: F.lit(v) for k, v in eye.items()}, "h13": -shift["h13"]})
    stops = out_of_frame(cars.select("track_id", "frame", "x", "y"), h, 100, 10_000)
    return rounded(backfill(cars, cars.select("track_id").distinct(), 10.0, 1.0, limits=stops).drop("clip"))


@query(
    f"""WITH {TRK}, kp AS (SELECT -track_id - 1 AS track_id, k AS frame, x, y FROM trk WHERE k % 10 = 0 AND k < 60), sp AS (SELECT track_id, unnest(range(min(frame), max(frame) + 1)) AS frame FROM kp GROUP BY track_id),
j AS (SELECT sp.track_id, sp.frame, a.x, a.y, a.frame AS here FROM sp LEFT JOIN kp a ON a.track_id = sp.track_id AND a.frame = sp.frame),
w AS (SELECT *, last_value(here IGNORE NULLS) OVER p AS f0, first_value(here IGNORE NULLS) OVER n AS f1, last_value(x IGNORE NULLS) OVER p AS x0, first_value(x IGNORE NULLS) OVER n AS x1, last_value(y IGNORE NULLS) OVER p AS y0, first_value(y IGNORE NULLS) OVER n AS y1 FROM j
  WINDOW p AS (PARTITION BY track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY track_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
d AS (SELECT track_id, frame, coalesce(x0 + (x1 - x0) * (frame - f0) / nullif(f1 - f0, 0), x0) + 2 AS x, coalesce(y0 + (y1 - y0) * (frame - f0) / nullif(f1 - f0, 0), y0) - 1 AS y FROM w),
b AS (SELECT track_id, frame, CASE WHEN count(*) OVER z = 7 THEN avg(x) OVER z ELSE x END AS x, CASE WHEN count(*) OVER z = 7 THEN avg(y) OVER z ELSE y END AS y FROM d WINDOW z AS (PARTITION BY track_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
g AS (SELECT *, lag(x) OVER v AS px, lead(x) OVER v AS nx, lag(y) OVER v AS py, lead(y) OVER v AS ny FROM b WINDOW v AS (PARTITION BY track_id ORDER BY frame))
SELECT track_id, frame, round(x, 5) AS x, round(y, 5) AS y, round(CASE WHEN px IS NULL AND nx IS NULL THEN NULL WHEN px IS NULL THEN 5 * sqrt(power(nx - x, 2) + power(ny - y, 2)) WHEN nx IS NULL THEN 5 * sqrt(power(x - px, 2) + power(y - py, 2)) ELSE 2.5 * sqrt(power(nx - px, 2) + power(ny - py, 2)) END, 4) AS speed FROM g"""
)
def manual_samples(spark, sf_dir):
    """Dense samples of hand-made key points, every tenth of a track's."""
    points = trk(spark, sf_dir).where("k % 10 = 0 and k < 60").select((-F.col("track_id") - 1).alias("track_id"), F.col("k").alias("frame"), "x", "y")
    out = manual_world(points, observed(spark, sf_dir)[1], 5.0)
    return out.select("track_id", "frame", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), F.round("speed", 4).alias("speed"))
