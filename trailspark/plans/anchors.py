"""Homographies corrected by landmarks that don't move."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.functions import geometry as g
from trailspark.operators import kernels, smoothing
from trailspark.operators.lineage import python_workers, stored
from trailspark.params import Anchors
from trailspark.plans.world import H_COLS

_AFFINE = ["a", "b", "c", "d", "e", "f"]


def corrections(marks: DataFrame, homographies: DataFrame, p: Anchors = Anchors()) -> DataFrame:
    """(frame, a..f, inliers, n): the affine map of each frame that takes its landmarks (frame, wx, wy, cx, cy) from where its homography puts them to where they stand, by seeded RANSAC.

    Frames with fewer than ``min_marks`` landmarks, or without a fit, are left out. A frame's landmarks are one group, and few.
    """
    python_workers(marks.sparkSession)
    h = homographies.select(F.col("frame").alias("__f"), *H_COLS)
    x, y = g.project([F.col(c) for c in H_COLS], F.col("cx"), F.col("cy"))
    rows = marks.join(h, F.col("frame") == F.col("__f")).select("frame", x.alias("x"), y.alias("y"), "wx", "wy")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["x", "y", "wx", "wy"])
        src, dst = f[["x", "y"]].to_numpy(), f[["wx", "wy"]].to_numpy()
        m = kernels.ransac_affine(src, dst, p.tolerance) if len(f) >= p.min_marks else None
        if m is None:
            return pd.DataFrame(columns=["frame", *_AFFINE, "inliers", "n"])
        near = np.hypot(*(src @ m[:, :2].T + m[:, 2] - dst).T) <= p.tolerance
        return pd.DataFrame([[f["frame"].iloc[0], *m.ravel(), int(near.sum()), len(f)]], columns=["frame", *_AFFINE, "inliers", "n"])

    return rows.groupBy("frame").applyInPandas(run, f"frame {dict(marks.dtypes)['frame']}, {', '.join(f'{c} double' for c in _AFFINE)}, inliers int, n int")


def steadied(found: DataFrame, homographies: DataFrame, p: Anchors = Anchors(), key: str = "clip") -> DataFrame:
    """The corrections of every frame: gaps and ends filled from the nearest fitted frames, smoothed over time; none below ``min_frames`` fitted ones."""
    spine = homographies.select("frame").withColumn(key, F.lit(0)).join(found.select("frame", *_AFFINE), "frame", "left")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        ok = np.flatnonzero(f["a"].notna().to_numpy())
        if len(ok) < p.min_frames:
            return f.iloc[:0]
        at = np.arange(len(f))
        return f.assign(**{c: kernels.gaussian(np.interp(at, ok, f[c].to_numpy()[ok]), p.smooth) for c in _AFFINE})

    return smoothing.whole_groups(spine, key, ["frame"], run, spine.schema).drop(key)


def anchored(marks: DataFrame, homographies: DataFrame, p: Anchors = Anchors()) -> DataFrame:
    """``homographies`` (frame, h11..h33) after their corrections, divided by the last element; as they were where too few frames can be corrected."""
    fixes = stored(steadied(corrections(marks, homographies, p), homographies, p))
    if not fixes.limit(1).count():
        return homographies
    both = homographies.join(fixes, "frame")
    m = g.normalised(g.product([*[F.col(c) for c in _AFFINE], 0.0, 0.0, 1.0], [F.col(c) for c in H_COLS]))
    return both.select("frame", *[v.alias(c) for v, c in zip(m, H_COLS, strict=True)])


def landmark_residual(marks: DataFrame, homographies: DataFrame) -> DataFrame:
    """One row: the median distance of the landmarks under the homographies from where they stand."""
    h = homographies.select(F.col("frame").alias("__f"), *H_COLS)
    x, y = g.project([F.col(c) for c in H_COLS], F.col("cx"), F.col("cy"))
    return marks.join(h, F.col("frame") == F.col("__f")).agg(F.percentile(F.hypot(x - F.col("wx"), y - F.col("wy")), F.lit(0.5)).alias("residual"), F.count("*").alias("n"))
