"""Readers and the tables they make, and the streaming twins, on small files."""

import json

import pytest
from pyspark.sql import functions as F

from trailspark.functions import geometry as g
from trailspark.operators import graph, joins, sequences, windows
from trailspark.sources import artifacts, schemas, trajectories
from trailspark.streaming import twins


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_tracks_and_homographies(spark, tmp_path):
    p = tmp_path / "tracks.json"
    p.write_text(json.dumps({"model": "m", "imgsz": 1, "conf": 0.1, "max_det": 9, "tracks": [{"id": 1, "cls": "car", "obs": [[0, 1.0, 2.0, 3.0, 4.0, 0.9], [2, 1.5, 2.0, 3.0, 4.0, 0.8]]}, {"id": 2, "cls": "dog", "obs": []}]}))
    doc = artifacts.load(spark, str(p), schemas.TRACKS)
    assert rows(artifacts.observations(doc, ("car",)).select("track_id", "frame", "cx")) == [(1, 0, 1.0), (1, 2, 1.5)]
    h = tmp_path / "h.json"
    h.write_text(json.dumps({"H": [[[1, 0, 5], [0, 1, 0], [0, 0, 1]]], "inliers": [7], "method": "ref-frame"}))
    assert rows(artifacts.homographies(artifacts.load(spark, str(h), schemas.HOMOGRAPHIES)).select("frame", "h13", "inliers", "method")) == [(0, 5.0, 7, "ref-frame")]
    assert artifacts.load_optional(spark, str(tmp_path / "none.json"), schemas.FOCUS).count() == 0


def test_world_and_flow(spark, tmp_path):
    w = tmp_path / "w.json"
    w.write_text(json.dumps({"car_len_px": 10, "tracks": [{"id": 3, "cls": "car", "static": False, "frames": [5, 6], "x": [1, 2], "y": [0, 0], "speed": [25, 25], "zv_mag": [None, 1.0], "zv_med": [0.1, 0.2], "runs": [[0, 5, 6]]}], "stop_events": [{"track": 3, "frame": 6, "t": 0.2, "t_wav": 0.2, "x": 2, "y": 0}]}))
    doc = artifacts.load(spark, str(w), schemas.WORLD)
    assert rows(artifacts.world_samples(doc, 25.0).select("track_id", "k", "frame", "t")) == [(3, 0, 5, 0.2), (3, 1, 6, 0.24)]
    assert rows(artifacts.state_runs(doc)) == [(3, 0, False, 5, 6)]
    assert rows(artifacts.stop_events(doc).select("track_id", "frame")) == [(3, 6)]
    assert rows(artifacts.world_tracks(doc).select("track_id", "n", "f0", "f1")) == [(3, 2, 5, 6)]


def test_overrides(spark):
    cur = spark.createDataFrame([(1, 5, "stopped"), (1, 9, "rolling")], "track_id int, frame int, state string")
    new = spark.createDataFrame([(1, 5, "braking"), (2, 1, "flying")], "track_id int, frame int, state string")
    assert rows(artifacts.add_override(cur, new)) == [(1, 5, "braking"), (1, 9, "rolling")]
    assert rows(artifacts.remove_override(cur, 1, 9)) == [(1, 5, "stopped")]
    assert rows(artifacts.remove_override(cur, 1)) == []


def test_wide_reader(spark):
    head = "track_id; type; traveled_d; avg_speed; lat; lon; speed; lon_acc; lat_acc; time"
    block = lambda t: f"37.0; 23.{t}; 36.0; ; ; {t}.0"
    lines = [head, "1; Car; 10; 5; " + "; ".join(block(t) for t in range(6)) + ";", "2; Bus; 1; 1; " + block(1) + ";", "3; Car; 1; 1; ; 1; 2; 3; 4; ;"]
    df = trajectories.parse_wide(spark.createDataFrame([(x,) for x in lines], "value string"), ("Car",))
    assert df.count() == 6 and {r.speed for r in df.collect()} == {10.0}
    assert abs(trajectories.to_local(df).agg(F.avg("x")).first()[0]) < 1e-6


def test_csv_readers(spark, tmp_path):
    (tmp_path / "s.csv").write_text("timestamp(ms),A,B\n0,1,0\n1000,1,0\n2000,0,1\n3000,1,1\n")
    s = trajectories.read_signals(spark, str(tmp_path / "s.csv"), ["A", "B"])
    assert rows(sequences.green_windows(s, ["head"])) == [("A", 0.0, 2.0)]
    (tmp_path / "t.csv").write_text("Local_Time,Drone_ID,Vehicle_ID,Vehicle_Class,Road_Section,Vehicle_Speed,Visibility\n07:00:00.500,1,1,0,A,3.5,1\n07:00:02.000,1,1,0,A,3.5,1\n")
    assert [r.t for r in trajectories.read_truth(spark, str(tmp_path / "t.csv")).orderBy("t").collect()] == [0.0, 1.5]
    (tmp_path / "i.csv").write_text("track_id,frame_id,timestamp_ms,agent_type,x,y,vx,vy\n1,0,40,car,0,0,3,4\n2,0,40,pedestrian,0,0,3,4\n")
    assert rows(trajectories.read_intersection(spark, str(tmp_path / "i.csv"), ("car",))) == [(1, 0, 0.04, 0.0, 0.0, 5.0)]


def test_square_is_half_open(spark):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    pts = spark.createDataFrame([(0.5, 0.5), (1.5, 0.5), (0.5, 0.0), (0.5, 1.0), (0.0, 0.5), (1.0, 0.5)], "x double, y double")
    inside = {(r.x, r.y) for r in pts.where(g.in_polygon(F.col("x"), F.col("y"), square)).collect()}
    assert (0.5, 0.5) in inside and (1.5, 0.5) not in inside
    assert ((0.5, 0.0) in inside) != ((0.5, 1.0) in inside) and ((0.0, 0.5) in inside) != ((1.0, 0.5) in inside)


def test_first_segment_wins_ties(spark):
    p = spark.createDataFrame([(5.0, 5.0)], "x double, y double").select(joins.station(F.col("x"), F.col("y"), [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)]).alias("p")).first().p
    assert (p.seg, p.d, p.s) == (0, 5.0, 5.0)


def test_refractory_counts_from_the_accepted(spark):
    e = spark.createDataFrame([(1, t) for t in (0.0, 1.5, 2.5, 3.0, 4.6)], "track_id int, t double")
    assert [t for _, t in rows(sequences.refractory(e, ["track_id"], "t", 2.0))] == [0.0, 2.5, 4.6]


def test_jump_drops_one_sample(spark):
    s = spark.createDataFrame([(1, f, 100.0 if f == 3 else float(f), 0.0) for f in range(6)], "track_id int, frame int, x double, y double")
    assert [r[1] for r in rows(sequences.screen_jumps(s, 2.0))] == [0, 1, 2, 4, 5]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "track_id int, k long, t double, x double, y double, speed double")
    assert windows.path_stats(e).count() == 0
    assert graph.road_components(graph.flow_grid(e, 24.0), 1, 55.0, 1).count() == 0
    assert sequences.runs(e.withColumn("s", F.lit(True)), "s").count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in graph.connected_components(edges).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}


@pytest.mark.parametrize("twin", ["hysteresis", "refractory"])
def test_streaming_twins(spark, tmp_path, twin):
    data = [(k % 3, k, float(k), float((k * 37) % 60)) for k in range(60)]
    df = spark.createDataFrame(data, "track_id int, k long, t double, speed double")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = twins.hysteresis(stream, 20.0, 40.0) if twin == "hysteresis" else twins.refractory(stream, 7.0)
    q = out.writeStream.format("memory").queryName(twin).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = rows(spark.table(twin))
    if twin == "refractory":
        assert got == rows(sequences.refractory(df.select("track_id", "t"), ["track_id"], "t", 7.0))
    else:
        r = sequences.runs(df.withColumn("stopped", sequences.hysteresis("speed", 20.0, 40.0)), "stopped")
        assert got == rows(r.select("track_id", "f0", "stopped"))


def test_streaming_windows(spark, tmp_path):
    df = spark.sql("select cast(id % 7 as int) as track_id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) as ts, double(id) as x, double(id) as speed from range(100) union all select 99, timestamp'2024-01-02 00:00:00', 0d, 0d")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out in (("tumbling", twins.tumbling_counts(stream, "10 seconds", "1 second")), ("sessions", twins.session_platoons(stream, "5 seconds", "1 second", "track_id")), ("field", twins.speed_field(stream, "10 seconds", 5.0, "1 second"))):
        out.writeStream.format("memory").queryName(name).outputMode("complete" if name == "field" else "append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    # the last window stays open under the watermark; the distinct tracks of the others are exact
    exact = df.where("track_id <> 99").groupBy(F.window("ts", "10 seconds")).agg(F.count("*").alias("n"), F.count_distinct("track_id").alias("tracks"))
    assert rows(spark.table("tumbling").select("window.start", "n", "tracks")) == rows(exact.select("window.start", "n", "tracks"))
    assert spark.table("field").agg(F.sum("n")).first()[0] == 101


@pytest.mark.parametrize("twin", ["hysteresis", "refractory"])
def test_streaming_state_ends_with_the_watermark(spark, tmp_path, twin):
    """With a watermark the rows are those of the plain twin, and quiet tracks keep no state."""
    df = spark.sql("select cast(id % 3 as int) as track_id, id as k, double(id) as t, double((id * 37) % 60) as speed, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) as ts from range(60)")
    late = spark.sql("select 9 as track_id, 0L as k, 0d as t, 10d as speed, timestamp'2024-01-03 00:00:00' as ts")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "1 second")
    out = twins.hysteresis(stream, 20.0, 40.0, time="ts") if twin == "hysteresis" else twins.refractory(stream, 7.0, clock="ts")
    for _ in range(2):
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        late.write.mode("append").parquet(str(tmp_path / "in"))
        late = late.withColumn("ts", F.col("ts") + F.expr("interval 2 days")).withColumn("track_id", F.lit(8))
    got = rows(spark.read.parquet(str(tmp_path / "out")).where("track_id < 8"))
    if twin == "refractory":
        assert got == rows(sequences.refractory(df.select("track_id", "t"), ["track_id"], "t", 7.0))
    else:
        r = sequences.runs(df.withColumn("stopped", sequences.hysteresis("speed", 20.0, 40.0)), "stopped")
        assert got == rows(r.select("track_id", "f0", "stopped"))
    states = [o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]]
    assert states and states[-1] <= 1
