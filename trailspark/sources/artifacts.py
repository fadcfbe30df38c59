"""JSON artifacts of a work directory as flat tables, and back."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailspark.sources import schemas


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One artifact, a whole JSON document, as one row. A missing file is Spark's own error."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def load_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The artifact, or no rows where Spark's file system finds none."""
    return load(spark, path, schema) if _exists(spark, path) else spark.createDataFrame([], schema)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def save(df: DataFrame, path: str) -> None:
    """A table as Parquet, replacing what is there."""
    df.write.mode("overwrite").parquet(path)


def save_json(df: DataFrame, path: str) -> None:
    """Whole documents, replacing what is there; rows with a ``clip`` become one document each, in a folder of their own."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy("clip") if "clip" in df.columns else writer).json(path)


def append_metrics(df: DataFrame, path: str) -> None:
    """Rows added to a JSON-lines log."""
    df.write.mode("append").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.METRICS).json(path)


def backed_up(spark: SparkSession, path: str, backup: str) -> None:
    """Copies the files at ``path`` to ``backup`` unless that is there already, so that what was first is kept."""
    if _exists(spark, backup):
        return
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, backup))
    conf = spark._jsc.hadoopConfiguration()
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, target.getFileSystem(conf), target, False, conf)


def cached(spark: SparkSession, path: str, parameters: dict, build) -> DataFrame:
    """The table of ``build()``, written once as Parquet under ``path`` for each set of ``parameters`` and read from there afterwards."""
    name = hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:24]
    place = f"{path.rstrip('/')}/{name}"
    if not _exists(spark, f"{place}/_SUCCESS"):
        build().write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)


def clip(meta: DataFrame) -> DataFrame:
    """Clip parameters; the frame count falls back on nothing here, see ``frame_count``."""
    return meta.select("src", "width", "height", "fps", "n_frames")


def frame_count(nb_frames, duration, fps):
    """The container's frame count, or the rounded product of duration and rate."""
    return F.coalesce(nb_frames.cast("int"), F.bround(duration * fps, 0).cast("int"))


def homographies(doc: DataFrame) -> DataFrame:
    """(frame, h11..h33, inliers, method)."""
    rows = doc.select("method", "inliers", F.posexplode("H").alias("frame", "h"))
    cells = [F.col("h")[r][c].alias(f"h{r + 1}{c + 1}") for r in range(3) for c in range(3)]
    return rows.select("frame", *cells, F.get(F.col("inliers"), F.col("frame")).alias("inliers"), "method")


def observations(doc: DataFrame, classes: tuple[str, ...] | None = None) -> DataFrame:
    """(track_id, cls, frame, cx, cy, w, h, conf), of some classes only where they are named."""
    rows = doc.select(F.explode("tracks").alias("t")).select(F.col("t.id").alias("track_id"), F.col("t.cls").alias("cls"), F.explode("t.obs").alias("o"))
    out = rows.select("track_id", "cls", F.col("o")[0].cast("int").alias("frame"), *[F.col("o")[i + 1].alias(c) for i, c in enumerate(("cx", "cy", "w", "h", "conf"))])
    return out.where(F.col("cls").isin(*classes)) if classes else out


def flow(doc: DataFrame) -> DataFrame:
    cols = ("frames", "vx", "vy", "n", "spread", "jac")
    rows = doc.select(F.explode("tracks").alias("t")).select(F.col("t.id").alias("track_id"), F.explode(F.arrays_zip(*[F.col(f"t.{c}").alias(c) for c in cols])).alias("z"))
    return rows.select("track_id", F.col("z.frames").alias("frame"), *[F.col(f"z.{c}").alias(c) for c in cols[1:]])


def slip(doc: DataFrame) -> DataFrame:
    """(frame, vx, vy, n); frames without a measurement keep nulls."""
    return doc.select(F.posexplode("bias").alias("frame", "b")).select("frame", F.get("b", F.lit(0)).alias("vx"), F.get("b", F.lit(1)).alias("vy"), F.get("b", F.lit(2)).cast("int").alias("n"))


def world_samples(doc: DataFrame, fps: float) -> DataFrame:
    cols = ("frames", "x", "y", "speed", "zv_mag")
    rows = doc.select(F.explode("tracks").alias("t")).select(F.col("t.id").alias("track_id"), F.posexplode(F.arrays_zip(*[F.col(f"t.{c}").alias(c) for c in cols])).alias("k", "z"))
    return rows.select("track_id", "k", F.col("z.frames").alias("frame"), (F.col("z.frames") / F.lit(float(fps))).alias("t"), *[F.col(f"z.{c}").alias(c) for c in cols[1:]])


def world_tracks(doc: DataFrame) -> DataFrame:
    t = doc.select(F.explode("tracks").alias("t"))
    return t.select(F.col("t.id").alias("track_id"), F.col("t.cls").alias("cls"), F.col("t.static").alias("static"), F.size("t.frames").alias("n"), F.array_min("t.frames").alias("f0"), F.array_max("t.frames").alias("f1"), F.get("t.zv_med", F.lit(0)).alias("zv_med_x"), F.get("t.zv_med", F.lit(1)).alias("zv_med_y"))


def state_runs(doc: DataFrame) -> DataFrame:
    rows = doc.select(F.explode("tracks").alias("t")).select(F.col("t.id").alias("track_id"), F.posexplode("t.runs").alias("run_no", "r"))
    return rows.select("track_id", "run_no", (F.col("r")[0] == 1).alias("stopped"), F.col("r")[1].alias("f0"), F.col("r")[2].alias("f1"))


def stop_events(doc: DataFrame) -> DataFrame:
    return doc.select(F.inline("stop_events")).withColumnRenamed("track", "track_id")


def polyline(doc: DataFrame, line_id: str = "line") -> DataFrame:
    """(line_id, v, x, y) of parallel coordinate arrays."""
    return doc.select(F.lit(line_id).alias("line_id"), F.posexplode(F.arrays_zip("x", "y")).alias("v", "p")).select("line_id", "v", "p.x", "p.y")


def segments(vertices: DataFrame) -> DataFrame:
    """(line_id, seg, ax, ay, bx, by, arc0, len) of polyline vertices; a line of one vertex has none."""
    w = Window.partitionBy("line_id").orderBy("v")
    rows = vertices.select("line_id", F.col("v").alias("seg"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by")).where("bx is not null")
    rows = rows.withColumn("len", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))
    before = Window.partitionBy("line_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("arc0", F.coalesce(F.sum("len").over(before), F.lit(0.0)))


def approaches(doc: DataFrame) -> DataFrame:
    """Approaches with their geometry as arrays of structs."""
    points = lambda c: F.transform(c, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return doc.select(F.explode("approaches").alias("a")).select(F.col("a.name").alias("name"), F.col("a.dir")[0].alias("dir_x"), F.col("a.dir")[1].alias("dir_y"), *[points(F.col(f"a.{c}")).alias(c) for c in ("in_line", "out_line", "queue_poly")], F.col("a.signal.phases").alias("phases"))


def overrides(doc: DataFrame) -> DataFrame:
    """State overrides in the order of track and frame; unknown states are left out."""
    rows = doc.select(F.inline("overrides")).where(F.col("state").isin(*schemas.STATES))
    return rows.select(F.col("track").alias("track_id"), "frame", "state").orderBy("track_id", "frame")


def add_override(current: DataFrame, new: DataFrame) -> DataFrame:
    """``current`` with the rows of ``new`` in place of those of the same track and frame. Rows of unknown states aren't added."""
    new = new.where(F.col("state").isin(*schemas.STATES))
    return current.join(new, ["track_id", "frame"], "left_anti").unionByName(new)


def remove_override(current: DataFrame, track_id: int, frame: int | None = None) -> DataFrame:
    """Without a track's override at a frame, or without all of the track's."""
    gone = F.col("track_id") == track_id
    return current.where(~(gone if frame is None else gone & (F.col("frame") == frame)))


def manual_points(doc: DataFrame) -> DataFrame:
    rows = doc.select(F.explode("tracks").alias("t")).select(F.col("t.id").alias("track_id"), F.explode("t.points").alias("p"))
    return rows.select("track_id", F.col("p")[0].cast("int").alias("frame"), F.col("p")[1].alias("x"), F.col("p")[2].alias("y"))
