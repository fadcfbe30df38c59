"""The kinematics stage and its neighbours on micro fixtures."""

import inspect
import json

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trailspark.params import Quality
from trailspark.plans import approaches, catalog, fields, scene
from trailspark.plans import world as w
from trailspark.plans.trk import trk


def clip(spark, tracks, frames=250):
    rows = [(i, "car", f, float(x), 5.0, 10.0, 5.0, 0.9) for i, xs in tracks.items() for f, x in enumerate(xs)]
    obs = spark.createDataFrame(rows, "track_id int, cls string, frame int, cx double, cy double, w double, h double, conf double")
    h = spark.range(frames).select(F.col("id").cast("int").alias("frame"), *[F.lit(float(v)).alias(c) for c, v in zip(w.H_COLS, (1, 0, 0, 0, 1, 0, 0, 0, 1))])
    return obs, h


def test_one_stop(spark):
    t = np.arange(225) / 25
    v = np.interp(t, [0, 3, 4, 7, 8], [30, 30, 0, 0, 30])
    go = np.concatenate([[0], np.cumsum((v[1:] + v[:-1]) / 2 / 25)])
    jump = go.copy()
    jump[40] += 500
    out = w.world(*clip(spark, {1: go, 2: np.full(225, 50.0), 3: go[:8], 4: jump}), 25.0)
    assert out.car_len == pytest.approx(10.0)
    assert {r.track_id for r in out.samples.select("track_id").distinct().collect()} == {1, 2, 4}
    assert [r.stopped for r in out.runs.where("track_id = 1").orderBy("run_no").collect()] == [False, True, False]
    assert out.samples.where("track_id = 4").count() == 224
    e = out.events.where("track_id = 1").collect()
    assert len(e) == 1 and abs(e[0].t - 4) < 0.4
    assert {r.track_id: r.static for r in out.tracks.collect()} == {1: False, 2: True, 4: False}


def test_manual_track(spark):
    _, h = clip(spark, {})
    points = spark.createDataFrame([(-1, 0, 0.0, 0.0), (-1, 50, 100.0, 0.0)], "track_id int, frame int, x double, y double")
    rows = w.manual_world(points, h, 25.0).collect()
    assert len(rows) == 51 and all(abs(r.speed - 50) < 1e-6 for r in rows)


def test_backfill_sees_earlier_fills(spark):
    rows = [(1, f, 0.0, 0.0, 0.0) for f in range(5, 20)] + [(2, f, 3.0, 0.0, 0.0) for f in range(8, 20)] + [(3, f, 90.0, 0.0, 50.0) for f in range(4, 20)] + [(4, f, 200.0, 0.0, 0.0) for f in range(3, 20)]
    df = spark.createDataFrame(rows, "track_id int, frame int, x double, y double, speed double")
    out = w.backfill(df, df.select("track_id").distinct(), 10.0, 1.0)
    got = {i: sorted(r.frame for r in out.where(f"track_id = {i}").collect()) for i in (1, 2, 3, 4)}
    assert got == {1: [0, 1, 2, 3, 4], 2: [], 3: [], 4: [0, 1, 2]}


def test_frames_and_tiles(spark):
    f = spark.createDataFrame([("a", i, float(i % 4), 1.0) for i in range(10)], "clip string, frame int, score double, shift double")
    assert [r.frame for r in w.key_frames(f, 4, 100.0).orderBy("frame").collect()] == [3, 7, 8 + 1]
    assert [r.keyframe for r in w.nearest_keyframe(spark.createDataFrame([(2,), (5,), (9,)], "frame int"), [0, 4, 6]).orderBy("frame").collect()] == [0, 4, 6]
    tiles = w.tile_grid(100, 50, 2, 1, 0.2)
    assert tiles == [(0, 0, 55, 50), (45, 0, 100, 50)]
    d = spark.createDataFrame([(0, "car", 5.0, 5.0, 4.0, 4.0, 0.9), (0, "car", 5.2, 5.0, 4.0, 4.0, 0.8), (0, "bus", 5.0, 5.0, 4.0, 4.0, 0.7), (0, "car", 50.0, 5.0, 4.0, 4.0, 0.6)], "frame int, cls string, cx double, cy double, w double, h double, conf double")
    assert sorted(r.conf for r in w.merged_tiles(d, 10).collect()) == [0.6, 0.7, 0.9]
    assert sorted(r.conf for r in w.merged_tiles(d, 2).collect()) == [0.7, 0.9]


def test_offset_line(spark):
    v = spark.createDataFrame([("a", 0, 0.0, 0.0), ("a", 1, 10.0, 0.0), ("a", 2, 20.0, 0.0)], "line_id string, v int, x double, y double")
    assert {(r.x, r.y) for r in w.offset_line(v, 2.0).collect()} == {(0.0, 2.0), (10.0, 2.0), (20.0, 2.0)}


def test_hidden_judges_all_tracks(spark):
    """Odd and moving tracks in a zone; static ones off the road."""
    places = {1: (5, 5), 2: (5, 5), 3: (50, 36), 4: (50, 34), 5: (50, 90)}
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in places.items() for _ in range(3)], "track_id long, x double, y double")
    static = spark.createDataFrame([(1,), (3,), (4,)], "track_id long")
    got = scene.hidden(df, [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]], static, [[(0.0, 0.0), (100.0, 0.0)]], 10.0)
    assert {r.track_id for r in got.collect()} == {1, 2, 3}


def test_editor_hides_the_hidden(spark):
    sf = "/root/testdata/sf0.001"
    hide = {r.track_id for r in scene.hidden_ids(spark, sf).collect()}
    every = {r.track_id for r in trk(spark, sf).select("track_id").distinct().collect()}
    assert any(i % 2 for i in hide) and {r.track_id for r in w.editor_documents(spark, sf).collect()} == {i for i in every - hide if i >= 0}


def test_stitch_refuses_far_fragments(spark):
    """The tail must end within 0.8 car lengths of the predicted place, or 0.3 of the way driven."""
    rows = [(1, 10.0, 20.0, 100.0, 200.0, 0.0, 0.0, 10.0), (2, 0.0, 8.0, 0.0, 82.0, 0.0, 0.0, 10.0), (3, 0.0, 8.0, 0.0, 800.0, 0.0, 0.0, 10.0), (4, 40.0, 50.0, 900.0, 910.0, 0.0, 0.0, 0.0), (5, 30.0, 38.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    tracks = spark.createDataFrame(rows, "track_id long, t0 double, t1 double, s0 double, s1 double, lat0 double, lat1 double, v double")
    pairs = scene.stitch_candidates(tracks, 3.0)
    assert {(r.head, r.tail) for r in pairs.collect()} == {(1, 2), (1, 3), (4, 5)}
    assert {(r.head, r.tail) for r in scene.stitch(pairs.withColumn("clip", F.lit("a")), 10.0).collect()} == {(1, 2)}


def test_entry_speed_is_that_of_the_first_steps(spark):
    rows = [(1, k, float(k), 3.0 * min(k, 10), 1.0 * k) for k in range(20)] + [(2, 0, 0.0, 5.0, 5.0)]
    got = scene.entry_speeds(spark.createDataFrame(rows, "track_id long, k long, t double, s double, off double"))
    assert {(r.track_id, r.v, r.w) for r in got.collect()} == {(1, 3.0, 1.0), (2, 0.0, 0.0)}


def test_wave_fits_boots_in_full(spark, monkeypatch):
    seen = {}
    whole = fields.wave_fit
    monkeypatch.setattr(fields, "wave_fit", lambda *a, **b: seen.update(inspect.signature(whole).bind(*a, **b).arguments) or whole(*a, **b))
    assert fields.wave_fits(spark, "/root/testdata/sf0.001").columns
    assert seen.get("boots", inspect.signature(whole).parameters["boots"].default) == Quality.boots == 2000


def test_mean_confidence_at_the_threshold_is_not_below_it(spark):
    """Summed as doubles in this order, the first track's mean is 0.49999999999999994."""
    confs = {1: [0.503, 0.506, 0.529, 0.462], 2: [0.503, 0.506, 0.529, 0.461], 3: [0.1, float("nan")], 4: [0.1, None]}
    rows = [(i, k, float(k), 1.0, 0.0, 0.0, c) for i, cs in confs.items() for k, c in enumerate(cs)]
    obs = spark.createDataFrame(rows, "track_id long, k long, t double, speed double, x double, y double, conf double").coalesce(1)
    assert {r.track_id for r in approaches.phantom_like(obs, obs).collect()} == {2, 4}


def test_phantom_tracks_at_the_threshold_are_those_of_the_sql(spark, tmp_path):
    """Means of 0.5 whose doubles, added along the track, come out below it, at it or above it; rows stand in another order."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(3, 1003, 5):
        ys = rng.integers(20, 81, 3).tolist()
        rows += [(len(rows) + j, pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=j), i, "view", 1.0, json.dumps({"k": y})) for j, y in enumerate([*ys, 200 - sum(ys)])]
    events = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"]).sample(frac=1, random_state=1)
    events.to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    want = duck.execute(catalog.ORACLE["phantom_tracks"]).fetchall()
    assert 0 < len(want) < 200
    assert sorted(tuple(r) for r in approaches.phantom_tracks(spark, str(tmp_path)).collect()) == sorted(want)


def test_chains_without_candidates_are_those_of_candidates(spark, monkeypatch):
    """Fragments with copies and equally near tails, two clips; the query makes no candidates."""
    rng = np.random.default_rng(6)
    rows = []
    for clip in ("a", "b"):
        for i in rng.permutation(90).tolist():
            t0, s0, lat0 = (float(x) for x in rng.integers(0, 6, 3))
            rows.append((clip, i, t0, t0 + int(rng.integers(0, 3)), s0, s0 + int(rng.integers(0, 3)), lat0, lat0, float(rng.integers(-1, 2)), float(rng.integers(0, 2))))
    tracks = spark.createDataFrame(rows, "clip string, track_id long, t0 double, t1 double, s0 double, s1 double, lat0 double, lat1 double, v double, w double")
    want = set()
    for clip in ("a", "b"):
        want |= {tuple(r) for r in scene.stitch(scene.stitch_candidates(tracks.where(F.col("clip") == clip), 4.0, 3.0).withColumn("clip", F.lit(clip)), 2.0).collect()}
    got = {tuple(r) for r in scene.chain_fragments(tracks, 4.0, 2.0, 3.0).collect()}
    assert got == want and len(got) > 50
    monkeypatch.setattr(scene, "stitch_candidates", None)
    assert scene.stitched(spark, "/root/testdata/sf0.001").count() >= 0


def test_candidates_of_one_time_are_many_tasks(spark, monkeypatch):
    """Pairs of fragments with copies, all heads in one bucket of time, against loops; copies are split into lists of three."""
    monkeypatch.setattr(scene, "_ALIKE", 3)
    rng = np.random.default_rng(8)
    ends = [(float(a), float(a + b), float(c), float(d), float(e), float(f), 0.5) for a, b, c, d, e, f in rng.integers(0, 5, (60, 6)).tolist()]
    rows = [(i, *ends[i % 60]) for i in range(400)]
    tracks = spark.createDataFrame(rows, "track_id long, t0 double, t1 double, s0 double, s1 double, lat0 double, lat1 double, v double")
    want = sorted((h[0], t[0], h[1] - t[2], abs(h[3] - 0.5 * (h[1] - t[2]) - t[4])) for h in rows for t in rows if h[0] != t[0] and t[2] < h[1] and h[1] - t[2] <= 5.0 and abs(h[5] - t[6]) <= 2.0)
    got = scene.stitch_candidates(tracks, 5.0, 2.0).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.head, r.tail, r.gap, r.miss) for r in got) == want
    assert len({r.task for r in got}) > 16


def test_fragments_are_copied_to_few_shares(spark, monkeypatch):
    sides, band = [], scene.joins.band
    monkeypatch.setattr(scene.joins, "band", lambda left, right, *a, **b: sides.extend((left.count(), right.count())) or band(left, right, *a, **b))
    rows = [(i, float(i), i + 0.5, 1.0 * i, 1.0 * i, 0.0, 0.0, 0.0) for i in range(40)]
    tracks = spark.createDataFrame(rows, "track_id long, t0 double, t1 double, s0 double, s1 double, lat0 double, lat1 double, v double")
    got = {tuple(r) for r in scene.stitch_candidates(tracks, 5.0).select("head", "tail").collect()}
    assert got == {(h, t) for h in range(40) for t in range(40) if h != t and t + 0.5 < h <= t + 5.5}
    assert sum(sides) <= 40 * 16
