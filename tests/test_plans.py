"""Composite plans on fixtures with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailspark.operators import kernels, smoothing
from trailspark.params import Roads
from trailspark.plans import anchors, fields, report, roads, shapes
from trailspark.plans import world as w

SF = "/root/testdata/sf0.001"


def eye(spark, frames, **other):
    values = dict(zip(w.H_COLS, (1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0)))
    return spark.range(frames).select(F.col("id").cast("int").alias("frame"), *[other.get(c, F.lit(float(v))).alias(c) for c, v in values.items()])


def dense_rts(t, z, sigma, jerk, zv=None, sv=None, gate=3.5):
    """Matrices, one step at a time, and a solve at every step back."""
    n, q = len(t), jerk**2
    have = np.isfinite(zv) if zv is not None else np.zeros(n, bool)
    wide = 50 * np.median(sigma)
    s, p = np.array([z[0], zv[0] if have[0] else 0.0, 0.0]), np.diag([sigma[0] ** 2, sv[0] ** 2 if have[0] else wide**2, wide**2])
    after, before, moves = [], [], []
    for k in range(n):
        f = np.eye(3)
        if k:
            d = t[k] - t[k - 1]
            f = np.array([[1, d, d * d / 2], [0, 1, d], [0, 0, 1]])
            s, p = f @ s, f @ p @ f.T + q * np.array([[d**5 / 20, d**4 / 8, d**3 / 6], [d**4 / 8, d**3 / 3, d**2 / 2], [d**3 / 6, d**2 / 2, d]])
        before.append((s, p))
        moves.append(f)
        for i, v, dev in [(0, z[k], sigma[k])] + ([(1, zv[k], sv[k])] if have[k] else []):
            miss, var = v - s[i], p[i, i] + dev**2
            if i == 0 or miss**2 < gate**2 * var:
                gain = p[:, i] / var
                s, p = s + gain * miss, p - np.outer(gain, p[i])
        after.append((s, p))
    out = [after[-1][0]]
    for k in range(n - 2, -1, -1):
        back = np.linalg.solve(before[k + 1][1], moves[k + 1] @ after[k][1]).T
        out.insert(0, after[k][0] + back @ (out[0] - before[k + 1][0]))
    return np.array(out)[:, 0], np.array(out)[:, 1]


def test_lanes_are_smoothed_as_dense_matrices_do():
    """Tracks of many lengths side by side, with and without speeds, gaps in time, one sample."""
    rng = np.random.default_rng(5)
    sizes = [1, 2, 40, 7, 90, 3, 40]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    n = bounds[-1]
    t = np.concatenate([np.cumsum(rng.random(m) * 0.3 + 0.02) for m in sizes])
    z, sigma = rng.normal(size=(n, 2)).cumsum(axis=0), rng.random(n) + 0.1
    zv, sv = np.where(rng.random((n, 1)) < 0.6, rng.normal(size=(n, 2)) * 4, np.nan), rng.random(n) + 0.2
    for speeds in ((None, None), (zv, sv)):
        p, v = smoothing.smooth_lanes(bounds, t, z, sigma, 2.0, *speeds)
        for a, b in zip(bounds[:-1], bounds[1:]):
            for axis in (0, 1):
                want = dense_rts(t[a:b], z[a:b, axis], sigma[a:b], 2.0, None if speeds[0] is None else zv[a:b, axis], None if speeds[0] is None else sv[a:b])
                assert np.allclose(p[a:b, axis], want[0], atol=1e-8) and np.allclose(v[a:b, axis], want[1], atol=1e-8)


def test_second_pass_weighs_both_axes(spark):
    """An outlier in x alone makes the samples around it count less in y too."""
    rng = np.random.default_rng(1)
    t = np.arange(60) / 10
    x, y = 3 * t, rng.normal(0, 0.3, 60)
    one = kernels.smooth_track(t, x, y, 10.0)
    x[25:32] += np.where(np.arange(7) % 2, 8.0, -8.0)
    two = kernels.smooth_track(t, x, y, 10.0)
    assert np.abs(one.y - two.y).max() > 1e-3


def test_local_medians():
    rng = np.random.default_rng(2)
    sizes = [1, 30, 5]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    t = np.concatenate([np.sort(rng.integers(0, 20, m)) / 4 for m in sizes]).astype(float)
    v = rng.normal(size=len(t))
    got = smoothing.local_medians(bounds, t, v, 0.5)
    for a, b in zip(bounds[:-1], bounds[1:]):
        assert np.allclose(got[a:b], [np.median(v[a:b][np.abs(t[a:b] - x) <= 0.5]) for x in t[a:b]])


def test_whole_groups_come_whole(spark):
    """Groups that span many batches reach the kernel in one piece and in order."""
    df = spark.range(0, 30_000).select((F.col("id") % 7).alias("g"), (30_000 - F.col("id")).alias("k"))
    seen = smoothing.whole_groups(df, "g", ["k"], lambda f: f.groupby("g", as_index=False).agg(n=("k", "size"), up=("k", lambda s: s.is_monotonic_increasing)), "g long, n long, up boolean", rows=2000)
    assert sorted((r.g, r.n, r.up) for r in seen.collect()) == [(g, len(range(g, 30_000, 7)), True) for g in range(7)]


def test_bootstrap_is_that_of_resampled_pairs():
    rng = np.random.default_rng(4)
    t, s = rng.integers(0, 12, 25).astype(float), rng.normal(size=25)
    draw = np.random.default_rng(3)
    want = []
    for _ in range(60):
        pick = draw.integers(0, 25, 25)
        i, j = np.triu_indices(25, 1)
        dt = t[pick][j] - t[pick][i]
        if (np.abs(dt) > 1e-9).any():
            want.append(np.median((s[pick][j] - s[pick][i])[np.abs(dt) > 1e-9] / dt[np.abs(dt) > 1e-9]))
    parts = [kernels.bootstrap_slopes(t, s, 60, 3, k, 4) for k in range(4)]
    assert np.allclose(kernels.bootstrap_slopes(t, s, 60), want) and np.allclose(sorted(np.concatenate(parts)), sorted(want))
    with pytest.raises(ValueError):
        kernels.theil_sen(np.zeros(kernels.MOST_POINTS + 1), np.zeros(kernels.MOST_POINTS + 1))


def test_wavelet_is_the_plain_convolution():
    rng = np.random.default_rng(6)
    for n in (8, 9, 40, 300):
        v = rng.normal(size=n).cumsum()
        want = np.zeros(n)
        for width in (0.16, 0.24, 0.36, 0.54, 0.8):
            a = max(width * 25, 1.5)
            half = min(int(10 * a) // 2, (n - 1) // 2)
            u = np.arange(-half, half + 1)
            psi = 2 / (math.sqrt(3 * a) * math.pi**0.25) * (1 - (u / a) ** 2) * np.exp(-((u / a) ** 2) / 2)
            want += np.array([sum(psi[j + half] * v[i + j] for j in u if 0 <= i + j < n) ** 2 for i in range(n)])
        assert np.allclose(kernels.wavelet_energy(v, 25.0), want)


def test_flow_is_freed_of_slip(spark):
    """Parked cars see a slip that grows with x; a driving car's measured speed has it too, and the smoothed one does not."""
    fps, frames = 10.0, 60
    rows = [(i, "car", f, 40.0 * i, 30.0 * (i % 4), 10.0, 5.0, 0.9) for i in range(14) for f in range(frames)]
    rows += [(99, "car", f, 20.0 * f / fps, 50.0, 10.0, 5.0, 0.9) for f in range(frames)]
    obs = spark.createDataFrame(rows, "track_id int, cls string, frame int, cx double, cy double, w double, h double, conf double")
    slip = lambda x: 3.0 + 0.01 * x
    flow = [(i, f, (20.0 if i == 99 else 0.0) + slip(x), 0.5, 9, 0.0, 1.0) for i, _, f, x, *_ in rows]
    flow = spark.createDataFrame(flow, "track_id int, frame int, vx double, vy double, n int, spread double, jac double")
    found = w.world(obs, eye(spark, frames), fps, flow)
    field = found.field.orderBy("frame").collect()
    assert len(field) > 40 and all(abs(r.a11 - 10.0) < 0.05 and abs(r.b1 - 3.0) < 0.05 and abs(r.b2 - 0.5) < 1e-6 for r in field)
    speed = [r.speed for r in found.samples.where("track_id = 99 and frame between 10 and 50").collect()]
    assert np.allclose(speed, 20.0, atol=0.3)
    tracks = {r.track_id: r for r in found.tracks.collect()}
    assert tracks[3].static and not tracks[99].static and abs(tracks[3].zv_med_x) < 0.05 and abs(tracks[99].zv_med_x - 20) < 0.3
    row = report.full_report(found, found.events, fps, boots=10).first()
    assert row.n_parked == 14 and row.parked_corrected < 0.01 and row.parked_bias < 0.01 and row.wave_slope is None


def stopping_queue(spark, fps=10.0, cars=16):
    """Cars that stop one after another, each a gap behind the one before: a stop wave that runs backwards."""
    rows, events = [], []
    for i in range(cars):
        stop_t, stop_x = 6.0 + i, 400.0 - 8.0 * i
        for f in range(int((cars + 8) * fps)):
            t = f / fps
            x = stop_x - max(stop_t - t, 0.0) * 20.0
            rows.append((i, f, f, t, x, 0.2 * (i % 3), 20.0 if t < stop_t else 0.0))
        events.append((i, stop_t, stop_x, 0.0))
    samples = spark.createDataFrame(rows, "track_id int, k int, frame int, t double, x double, y double, speed double")
    return samples, spark.createDataFrame(events, "track_id int, t double, x double, y double")


def test_waves_run_backwards(spark):
    samples, events = stopping_queue(spark)
    r = fields.waves(samples, events, 10.0, 2.2, cell_s=1.0, boots=200).collect()
    assert len(r) == 1 and r[0].slope == pytest.approx(-8.0, abs=0.2) and r[0].low <= r[0].slope <= r[0].high and r[0].backward and r[0].n >= 10
    assert r[0].kmh == pytest.approx(8.0 * 4.5 / 10 * 3.6, abs=0.4) and r[0].in_band
    assert fields.waves(samples, events.limit(2), 10.0, 2.2).count() == 0


def test_wave_fits_are_the_plain_ones(spark):
    """The registered query, the only one without SQL, against loops over its inputs."""
    got = fields.wave_fits(spark, SF).collect()
    front, events = fields._front_and_events(spark, SF)
    f, e = front.toPandas(), events.toPandas().sort_values(["t", "s"])

    def line(t, s):
        m = [(s[j] - s[i]) / (t[j] - t[i]) for i in range(len(t)) for j in range(i + 1, len(t)) if abs(t[j] - t[i]) > 1e-9]
        return np.median(m), np.median(np.asarray(s) - np.median(m) * np.asarray(t))

    assert [r.wave for r in got] == (["all"] if len(f) or len(e) else [])
    for r in got:
        if len(f) < 4 or len(e) < 3:
            assert r.slope is None
            continue
        m, c = line(f.t.tolist(), f.s.tolist())
        on = e[np.abs(e.s - (m * e.t + c)) < 60]
        assert r.n == len(on) and r.front_slope == pytest.approx(m)
        if len(on) >= 4:
            own = line(on.t.tolist(), on.s.tolist())
            low, high = kernels.bootstrap_slope(on.t, on.s)
            assert (r.slope, r.low, r.high) == pytest.approx((own[0], low, high))


def test_two_lanes(spark):
    rng = np.random.default_rng(4)
    offsets = np.concatenate([rng.normal(m, 12, 8000) for m in (-70, 70)])
    df = spark.createDataFrame([(1, float(v)) for v in offsets] + [(2, 0.0)], "road int, off double")
    got = {r.road: r for r in roads.lanes(df, "road", 30.0).collect()}
    assert len(got[1].lanes) == 2 and abs(got[1].lane_halfwidth - 70) < 6 and got[2].lanes == [0.0] and got[2].lane_halfwidth == pytest.approx(0.35 * 30)


def test_roads_that_wind_drop_out(spark):
    """A way to and fro is no road; a straight one is."""
    path = [(x if leg % 2 == 0 else 396 - x, 100.0 * leg) for leg in range(7) for x in range(0, 400, 6)]
    path = [q for a, b in zip(path, path[1:] + path[-1:]) for q in ([a] if a[1] == b[1] else [(a[0], a[1] + d) for d in range(0, 100, 6)])]
    loop = [(1, k, x + 30.0, y + 30.0) for k, (x, y) in enumerate(path)]
    straight = [(i, k, 1000.0 + 6 * k, 50.0 + i) for i in range(2, 8) for k in range(120)]
    df = spark.createDataFrame(loop + straight, "track_id int, k int, x double, y double")
    lines, found = roads.infer(df, 20.0, Roads(min_cells=3, min_near=50, min_in_bin=2, max_angle_deg=181.0))
    rows = found.collect()
    assert len(rows) == 1 and rows[0].n_obs == 720 and lines.agg(F.min("x")).first()[0] > 900


def test_anchors_take_the_shift_away(spark):
    """Homographies that drift are brought back by landmarks, a fifth of which are wrong; gaps are bridged."""
    rng = np.random.default_rng(8)
    frames = 30
    h = eye(spark, frames, h13=F.col("id") * 0.4)
    marks = []
    for i in range(15):
        x, y = (float(v) for v in rng.random(2) * 400)
        for f in range(frames):
            if f in (7, 8):
                continue
            off = 60.0 if i % 5 == 0 else 0.0
            marks.append((f, x, y, x + off, y))
    marks = spark.createDataFrame(marks, "frame int, wx double, wy double, cx double, cy double")
    before, after = anchors.landmark_residual(marks, h).first(), anchors.landmark_residual(marks, anchors.anchored(marks, h)).first()
    assert before.residual > 4 and after.residual < 0.2 and after.n == before.n
    fixed = anchors.corrections(marks, h)
    assert fixed.count() == frames - 2 and {r.inliers for r in fixed.collect()} == {12}
    assert anchors.anchored(marks.where("frame < 3"), h).exceptAll(h).count() == 0


def test_recovered_lane_is_whole(spark):
    """A focus car gets its earlier fragment, its gap bridged, and a standing one is there from frame 0."""
    rows = [(1, f, 3.0 * f, 0.0, 30.0) for f in range(20, 40)] + [(2, f, 3.0 * f, 0.0, 30.0) for f in range(0, 15)] + [(3, f, 500.0, 5.0, 0.0) for f in range(10, 40)] + [(4, f, 3.0 * f, 300.0, 30.0) for f in range(0, 15)]
    df = spark.createDataFrame([(i, f, f / 10, x, y, v, x, y) for i, f, x, y, v in rows], "track_id int, frame int, t double, x double, y double, speed double, s double, off double")
    focus = spark.createDataFrame([(1,), (3,)], "track_id int")
    out = report.recover(df.where("track_id <> 2"), df.where("track_id = 2"), focus, 10.0, 1.0, 10.0).collect()
    got = {i: sorted(r.frame for r in out if r.track_id == i) for i in (1, 2, 3, 4)}
    assert got == {1: list(range(40)), 2: [], 3: list(range(40)), 4: []}
    assert all(r.x == pytest.approx(3.0 * r.frame) for r in out if r.track_id == 1) and all(r.x == 500.0 for r in out if r.track_id == 3)
    assert sorted(r.frame for r in out if r.filled) == [15, 16, 17, 18, 19]


def test_chevrons_and_corridors():
    line = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)]
    assert shapes.corridor(line, 5.0) == [(-5.0, 0.0), *line, (10.0, 15.0)]
    tips = [c[:2] for c in shapes.chevrons(line, 4.0, 1.0)]
    assert tips == [(0.0, 0.0), (4.0, 0.0), (8.0, 0.0), (10.0, 2.0), (10.0, 6.0)]
    x, y, ax, ay, bx, by = shapes.chevrons(line, 4.0, 1.0)[1]
    assert (ax, ay) == (3.0, -1.0) and (bx, by) == (3.0, 1.0)


def test_stored_tables_are_released(spark):
    from trailspark.operators import lineage

    df = lineage.stored(spark.range(5))
    assert df.count() == 5
    lineage.release(spark)
    again = lineage.stored(spark.range(3))
    assert again.count() == 3
    with pytest.raises(Exception):
        df.count()
