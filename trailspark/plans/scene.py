"""Focus lanes, roads and scene tables: what the drawings of the analytics are made from."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailspark.functions import geometry as g
from trailspark.operators import joins, kernels, sequences, windows
from trailspark.operators.lineage import python_workers
from trailspark.params import Focus
from trailspark.plans.kinematics import POLYLINE, STATION, simple_states, static_tracks, with_station
from trailspark.plans.trk import HIGH, LOW, TRK, query, rounded, trk


def pick_focus(offsets: DataFrame, band: tuple[float, float], include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Tracks whose median signed offset is in the band, and those included, without those excluded."""
    out = offsets.groupBy("track_id").agg(F.percentile("off", F.lit(0.5)).alias("m")).where(F.col("m").between(*band)).select("track_id")
    out = out.union(include.select("track_id")).distinct() if include is not None else out
    return out.join(exclude.select("track_id"), "track_id", "left_anti") if exclude is not None else out


def guide(samples: DataFrame, step: float, least: int = 6, half: int = 3) -> DataFrame:
    """Vertices (v, x, y) of a guide: medians of the samples in station bins of ``step`` with ``least`` of them, smoothed where seven are."""
    bins = samples.groupBy(F.floor(F.col("s") / step).alias("v")).agg(F.count("*").alias("n"), F.percentile("x", F.lit(0.5)).alias("x"), F.percentile("y", F.lit(0.5)).alias("y")).where(F.col("n") >= least)
    one = bins.withColumn("line", F.lit(0))
    smooth = [windows.box_filter(c, half, "line", "v", valid_only=True).alias(c) for c in ("x", "y")]
    return one.select("v", *smooth).where("x is not null")


def hidden(samples: DataFrame, zones: list[list[tuple[float, float]]], static: DataFrame | None = None, roads: list[list[tuple[float, float]]] = (), car: float = 0.0) -> DataFrame:
    """Tracks whose median place is in one of the zones, and ``static`` ones whose median place is farther than 3.5 car lengths from every road."""
    m = samples.groupBy("track_id").agg(F.percentile("x", F.lit(0.5)).alias("x"), F.percentile("y", F.lit(0.5)).alias("y"))
    hit = F.lit(False)
    for z in zones:
        hit = hit | g.in_polygon(F.col("x"), F.col("y"), z)
    if static is not None and roads:
        off = F.lit(True)
        for r in roads:
            off = off & (joins.station(F.col("x"), F.col("y"), r)["d"] > Focus.off_road * car)
        m = m.join(static.select("track_id").distinct().withColumn("still", F.lit(True)), "track_id", "left")
        hit = hit | (F.coalesce("still", F.lit(False)) & off)
    return m.where(hit).select("track_id")


#: Ids of equal fragments in one row at most, and shares that heads and tails each are dealt to; every two shares are one task's.
_ALIKE, _SHARES = 1024, 8


def _alike(ends: DataFrame, id_: str) -> DataFrame:
    """Rows that are equal but for their id as one, with the ids as a list of ``_ALIKE`` at most."""
    same = [c for c in ends.columns if c != id_]
    part = F.floor((F.row_number().over(Window.partitionBy(*same).orderBy(id_)) - 1) / _ALIKE)
    return ends.withColumn("__part", part).groupBy(*same, "__part").agg(F.collect_list(id_).alias(id_))


def alike_pairs(tracks: DataFrame, max_gap: float, max_lateral: float = Focus.lateral_px) -> DataFrame:
    """The pairs of :func:`stitch_candidates` between lists of equal heads and of equal tails; :func:`expanded` tells the ids apart.

    The pairs come from an equi-join on buckets of time and shares of both sides, so that heads of
    one time are no single task's, and a row is copied to the shares of the other side only.
    """
    tracks = tracks if "w" in tracks.columns else tracks.withColumn("w", F.lit(0.0))
    head = _alike(tracks.select(F.col("track_id").alias("head"), F.col("t0").alias("ht"), F.col("s0").alias("hs"), F.col("lat0").alias("hl"), F.col("v").alias("hv"), F.col("w").alias("hw")), "head")
    tail = _alike(tracks.select(F.col("track_id").alias("tail"), F.col("t1").alias("tt"), F.col("s1").alias("ts"), F.col("lat1").alias("tl")), "tail")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SHARES - 1).cast("long")))
    dealt = lambda *c: F.pmod(F.xxhash64(*c, "__part"), F.lit(_SHARES))
    head = head.withColumn("hshare", dealt("ht", "hs", "hl")).drop("__part").withColumn("tshare", every)
    tail = tail.withColumn("tshare", dealt("tt", "ts", "tl")).drop("__part").withColumn("hshare", every)
    pairs = joins.band(head, tail, "ht", "tt", max_gap, 0.0, max_gap, ["hshare", "tshare"], _SHARES**2).where((F.col("tt") < F.col("ht")) & (F.abs(F.col("hl") - F.col("tl")) <= max_lateral))
    gap = F.col("ht") - F.col("tt")
    miss = F.abs(F.col("hs") - F.col("hv") * gap - F.col("ts"))
    return pairs.select("head", "tail", gap.alias("gap"), miss.alias("miss"), F.hypot(miss, F.col("hl") - F.col("hw") * gap - F.col("tl")).alias("far"), F.hypot("hv", "hw").alias("speed"), F.col("ht").alias("t0"))


def expanded(pairs: DataFrame) -> DataFrame:
    """Pairs of ids for pairs of lists of them, none with itself."""
    rest = [c for c in pairs.columns if c not in ("head", "tail")]
    return pairs.select(F.explode("head").alias("head"), "tail", *rest).select("head", F.explode("tail").alias("tail"), *rest).where("head <> tail")


def stitch_candidates(tracks: DataFrame, max_gap: float, max_lateral: float = Focus.lateral_px) -> DataFrame:
    """Pairs (head, tail) where the tail ends before the head begins, near in time, lateral place and predicted station.

    ``tracks`` has track_id, t0, t1, s0, s1, lat0, lat1, v (entry speed along the line) and
    may have w (entry speed across it). ``far`` is the distance of the tail's end from the
    predicted place, ``speed`` that of the entry.
    """
    return expanded(alike_pairs(tracks, max_gap, max_lateral))


def entry_speeds(samples: DataFrame, most: int = 10) -> DataFrame:
    """Speeds v along and w across the line of each track over its first ``most`` steps at most (0 for a track of one sample)."""
    w = windows.along("track_id", "k")
    first = samples.withColumn("__i", F.row_number().over(w)).where(F.col("__i") <= most + 1)
    ends = first.groupBy("track_id").agg(F.min_by(F.struct("t", "s", "off"), "k").alias("a"), F.max_by(F.struct("t", "s", "off"), "k").alias("b"))
    speed = lambda c: F.coalesce(F.try_divide(F.col(f"b.{c}") - F.col(f"a.{c}"), F.col("b.t") - F.col("a.t")), F.lit(0.0))
    return ends.select("track_id", speed("s").alias("v"), speed("off").alias("w"))


def within_reach(candidates: DataFrame, car: float) -> DataFrame:
    """Candidates whose tail ends no farther from the predicted place than 0.8 car lengths or 0.3 of the way driven in the gap."""
    return candidates.where(F.col("far") <= F.greatest(F.lit(Focus.reach_cars * car), Focus.reach_share * F.col("speed") * F.col("gap")))


def stitch(candidates: DataFrame, car: float, clip: str = "clip") -> DataFrame:
    """Chains of fragments: (clip, head, link, tail), ``link`` counting back from the head's own first sample.

    Heads go in order of time; each takes the nearest free tail, goes on from that one's own
    first sample, and so on until none is in reach. A tail is used once and starts no chain
    of its own afterwards. One clip's candidates at a time.
    """
    python_workers(candidates.sparkSession)
    candidates = within_reach(candidates, car)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t0", "head", "far", "tail"])
        tails = {h: g["tail"].tolist() for h, g in rows.groupby("head", sort=False)}
        used: set = set()
        out = []
        for head in rows["head"].drop_duplicates().tolist():
            at, link = None if head in used else head, 0
            while at is not None:
                at = next((t for t in tails.get(at, ()) if t not in used and t != head), None)
                if at is not None:
                    used.add(at)
                    link += 1
                    out.append((rows[clip].iloc[0], head, link, at))
        return pd.DataFrame(out, columns=[clip, "head", "link", "tail"])

    kinds = dict(candidates.dtypes)
    return candidates.groupBy(clip).applyInPandas(run, f"{clip} {kinds[clip]}, head {kinds['head']}, link int, tail {kinds['tail']}")


def chain_fragments(tracks: DataFrame, max_gap: float, car: float, max_lateral: float = Focus.lateral_px, clip: str = "clip") -> DataFrame:
    """The chains that :func:`stitch` makes of the candidates of ``tracks`` (as of :func:`stitch_candidates`, with ``clip``), without making the candidates.

    Each step looks for the nearest free tail among one clip's fragments, which are one group;
    its work grows with their number times that of different ends, its memory with their number.
    """
    python_workers(tracks.sparkSession)
    tracks = tracks if "w" in tracks.columns else tracks.withColumn("w", F.lit(0.0))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t0", "track_id"])
        ids = rows["track_id"].to_numpy()
        found = kernels.nearest_chains(ids, *(rows[c].to_numpy(dtype=float) for c in ("t0", "t1", "s0", "s1", "lat0", "lat1", "v", "w")), max_gap, max_lateral, Focus.reach_cars * car, Focus.reach_share)
        return pd.DataFrame([(rows[clip].iloc[0], ids[head], link, ids[tail]) for head, link, tail in found], columns=[clip, "head", "link", "tail"])

    kinds = dict(tracks.dtypes)
    cols = [clip, "track_id", "t0", "t1", "s0", "s1", "lat0", "lat1", "v", "w"]
    return tracks.select(*cols).where("track_id is not null").groupBy(clip).applyInPandas(run, f"{clip} {kinds[clip]}, head {kinds['track_id']}, link int, tail {kinds['track_id']}")


def absorbed(samples: DataFrame, chains: DataFrame) -> DataFrame:
    """``samples`` in which the fragments of a chain bear its head's id, so that they are no tracks of their own any more."""
    to = chains.select(F.col("tail").alias("track_id"), F.col("head").alias("__head"))
    return samples.join(to, "track_id", "left").withColumn("track_id", F.coalesce("__head", "track_id")).drop("__head")


def centerline_pick(paths: DataFrame, near: DataFrame, min_path: float) -> DataFrame:
    """The track near most events, the longest path deciding ties, then the least id."""
    covered = near.groupBy("track_id").agg(F.count_distinct("event").alias("events"))
    return paths.where(F.col("path") > min_path).join(covered, "track_id").orderBy(F.desc("events"), F.desc("path"), "track_id").limit(1)


def movement_paths(samples: DataFrame, points: int = 64, least: int = 3) -> DataFrame:
    """Median path of each ``movement`` with ``least`` tracks, resampled to ``points`` places: movement, i, x, y, n."""
    placed = windows.resample_arc(samples, points).join(samples.select("track_id", "movement").distinct(), "track_id")
    return placed.groupBy("movement", "i").agg(F.percentile("x", F.lit(0.5)).alias("x"), F.percentile("y", F.lit(0.5)).alias("y"), F.count("*").alias("n")).where(F.col("n") >= least)


def signal_state(departures: DataFrame, frames: DataFrame, gap: float, tail: float) -> DataFrame:
    """``frames`` (t) with ``green``: within a run of departures at most ``gap`` apart, or ``tail`` after its end."""
    runs = sequences.platoons(departures.withColumn("one", F.lit(0)), ["one"], gap, 1, 1).select((F.col("t0")).alias("a"), (F.col("t1") + tail).alias("b"), "platoon")
    hit = joins.within(frames.withColumn("one", F.lit(0)), runs.withColumn("one", F.lit(0)), ["one"], "t", "a", "b").select("t").distinct().withColumn("green", F.lit(True))
    return frames.join(hit, "t", "left").withColumn("green", F.coalesce("green", F.lit(False)))


def counters(states: DataFrame, frame: str = "k") -> DataFrame:
    """How many tracks are in each state at each frame."""
    return states.groupBy(frame).pivot("state", ["rolling", "braking", "stopped"]).agg(F.count(F.lit(1))).na.fill(0)


def trails(samples: DataFrame, length: int, min_straight: float = 0.8, key: str = "track_id", order: str = "k") -> DataFrame:
    """The last ``length`` samples' chord and path at each sample, and whether the trail is straight enough to draw."""
    w = windows.along(key, order).rowsBetween(-length, 0)
    tail = windows.along(key, order).rowsBetween(-length + 1, 0)
    df = windows.steps(samples, key, order)
    chord = F.hypot(F.col("x") - F.first("x").over(w), F.col("y") - F.first("y").over(w))
    df = df.withColumns({"chord": chord, "trail": F.coalesce(F.sum("step").over(tail), F.lit(0.0))})
    return df.withColumn("straight", F.coalesce(F.try_divide("chord", "trail") >= min_straight, F.lit(False)))


ZONES = [[(0.0, 0.0), (80.0, 0.0), (80.0, 60.0), (0.0, 60.0)], [(200.0, 40.0), (300.0, 40.0), (300.0, 100.0), (200.0, 100.0)]]


HIDDEN = f"""{STATION}, md AS (SELECT track_id, quantile_cont(x, 0.5) AS x, quantile_cont(y, 0.5) AS y FROM trk GROUP BY track_id),
hs AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM trk WINDOW w AS (PARTITION BY track_id ORDER BY k)),
hp AS (SELECT track_id FROM hs GROUP BY track_id HAVING max(t) - min(t) >= 3 AND sqrt(power(arg_max(x, k) - arg_min(x, k), 2) + power(arg_max(y, k) - arg_min(y, k), 2)) < 60 AND sum(sqrt(dx * dx + dy * dy)) < 9000),
hd AS (SELECT md.track_id, min(sqrt(power(x - ax - u * (bx - ax), 2) + power(y - ay - u * (by_ - ay), 2))) AS d FROM (SELECT md.*, seg.*, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) AS u FROM md, seg) md GROUP BY md.track_id),
hid AS (SELECT track_id FROM md JOIN hd USING (track_id) WHERE ((y > 0) <> (y > 60) AND x < 80 AND x >= 0) OR ((y > 40) <> (y > 100) AND x < 300 AND x >= 200) OR (track_id IN (SELECT track_id FROM hp) AND d > 3.5 * 4))"""


@query(f"WITH {HIDDEN} SELECT track_id FROM hid")
def hidden_ids(spark, sf_dir):
    """All tracks in a zone, and the static ones off the road."""
    return hidden(trk(spark, sf_dir), ZONES, static_tracks(spark, sf_dir), [POLYLINE], 4.0)


@query(
    f"""WITH {STATION}, xy AS (SELECT sta.*, trk.x, trk.y FROM sta JOIN trk USING (track_id, k)), b AS (SELECT floor(s / 20)::BIGINT AS v, count(*) AS n, quantile_cont(x, 0.5) AS x, quantile_cont(y, 0.5) AS y FROM xy GROUP BY 1 HAVING count(*) >= 6),
w AS (SELECT v, count(*) OVER z AS c, avg(x) OVER z AS x, avg(y) OVER z AS y FROM b WINDOW z AS (ORDER BY v ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) SELECT v, round(x, 6) AS x, round(y, 6) AS y FROM w WHERE c = 7"""
)
def guide_path(spark, sf_dir):
    return rounded(guide(with_station(trk(spark, sf_dir)), 20.0))


@query(
    f"""WITH {STATION}, a AS (SELECT track_id, min(t) AS t0, max(t) AS t1, arg_min(s, k) AS s0, arg_max(s, k) AS s1, arg_min(off, k) AS lat0, arg_max(off, k) AS lat1 FROM sta GROUP BY track_id)
SELECT h.track_id AS head, t.track_id AS tail, round(h.t0 + 2592000 - t.t1, 3) AS gap, round(abs(h.s0 - t.s1), 6) AS miss FROM a h JOIN a t ON h.track_id <> t.track_id AND t.t1 < h.t0 + 2592000 AND h.t0 + 2592000 - t.t1 <= 259200 AND abs(h.lat0 - t.lat1) <= 25"""
)
def stitch_pairs(spark, sf_dir):
    """Candidates, heads being taken 30 days later so that some tracks end before others begin. As in the SQL, none moves at its entry."""
    a = _fragments(with_station(trk(spark, sf_dir))).withColumn("v", F.lit(0.0))
    return expanded(alike_pairs(a, 259200.0).select("head", "tail", F.round("gap", 3).alias("gap"), F.round("miss", 6).alias("miss")))


def _fragments(s):
    return s.groupBy("track_id").agg((F.min("t") + 2592000.0).alias("t0"), F.max("t").alias("t1"), F.min_by("s", "k").alias("s0"), F.max_by("s", "k").alias("s1"), F.min_by("off", "k").alias("lat0"), F.max_by("off", "k").alias("lat1"))


CHAINS = f"""{STATION}, fi AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY k) AS i FROM sta),
sp AS (SELECT track_id, coalesce((arg_max(s, k) - arg_min(s, k)) / nullif(max(t) - min(t), 0), 0) AS v, coalesce((arg_max(off, k) - arg_min(off, k)) / nullif(max(t) - min(t), 0), 0) AS w FROM fi WHERE i <= 11 GROUP BY track_id),
fr AS (SELECT track_id, min(t) + 2592000 AS t0, max(t) AS t1, arg_min(s, k) AS s0, arg_max(s, k) AS s1, arg_min(off, k) AS lat0, arg_max(off, k) AS lat1 FROM sta GROUP BY track_id),
cd AS (SELECT h.track_id AS head, t.track_id AS tail, h.t0, sqrt(power(h.s0 - v * (h.t0 - t.t1) - t.s1, 2) + power(h.lat0 - w * (h.t0 - t.t1) - t.lat1, 2)) AS far, sqrt(v * v + w * w) * (h.t0 - t.t1) AS way
  FROM fr h JOIN sp USING (track_id) JOIN fr t ON h.track_id <> t.track_id AND t.t1 < h.t0 AND h.t0 - t.t1 <= 259200 AND abs(h.lat0 - t.lat1) <= 25),
ca AS (SELECT * FROM cd WHERE far <= greatest(0.8 * 25, 0.3 * way)),
tl AS (SELECT head, list(tail ORDER BY far, tail) AS tails FROM ca GROUP BY head), hs AS (SELECT head, row_number() OVER (ORDER BY min(t0), head) AS n FROM ca GROUP BY head),
ch AS (
  SELECT n, head, head AS cur, 0 AS link, []::BIGINT[] AS used, NULL::BIGINT AS tail FROM hs WHERE n = 1
  UNION ALL
  SELECT CASE WHEN t IS NULL THEN g.n ELSE c.n END, CASE WHEN t IS NULL THEN g.head ELSE c.head END, CASE WHEN t IS NOT NULL THEN t WHEN list_contains(c.used, g.head) THEN -1 ELSE g.head END, CASE WHEN t IS NULL THEN 0 ELSE c.link + 1 END, CASE WHEN t IS NULL THEN c.used ELSE list_append(c.used, t) END, t
  FROM (SELECT ch.*, list_filter(tl.tails, lambda x: NOT list_contains(ch.used, x) AND x <> ch.head)[1] AS t FROM ch LEFT JOIN tl ON tl.head = ch.cur) c LEFT JOIN hs g ON g.n = c.n + 1 WHERE t IS NOT NULL OR g.n IS NOT NULL),
cn AS (SELECT head, link, tail FROM ch WHERE tail IS NOT NULL)"""


@query(f"WITH RECURSIVE {CHAINS} SELECT head, link::INT AS link, tail FROM cn")
def stitched(spark, sf_dir):
    """Chains by real entry speeds, tails within reach."""
    return chains(spark, sf_dir).select("head", "link", "tail")


def chains(spark, sf_dir):
    s = with_station(trk(spark, sf_dir))
    a = _fragments(s).join(entry_speeds(s), "track_id")
    return chain_fragments(a.withColumn("clip", F.lit("a")), 259200.0, 25.0)


@query(f"WITH RECURSIVE {CHAINS} SELECT coalesce(cn.head, trk.track_id) AS track_id, count(*) AS n FROM trk LEFT JOIN cn ON cn.tail = trk.track_id GROUP BY 1")
def merged_tracks(spark, sf_dir):
    """Tracks with the fragments that they absorbed, which are gone as tracks."""
    return absorbed(trk(spark, sf_dir).select("track_id", "k"), chains(spark, sf_dir)).groupBy("track_id").agg(F.count("*").alias("n"))


@query(
    f"""WITH {TRK}, p AS (SELECT track_id, sum(d) AS path FROM (SELECT track_id, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS d FROM trk WINDOW w AS (PARTITION BY track_id ORDER BY k)) GROUP BY track_id),
n AS (SELECT s.track_id, count(DISTINCT e.id) AS events FROM trk s JOIN (VALUES (0, 50.0, 20.0), (1, 120.0, 60.0), (2, 240.0, 30.0)) e(id, ex, ey) ON sqrt(power(s.x - ex, 2) + power(s.y - ey, 2)) < 15 GROUP BY s.track_id)
SELECT track_id, round(path, 5) AS path, events FROM p JOIN n USING (track_id) WHERE path > 100 ORDER BY events DESC, p.path DESC, track_id LIMIT 1"""
)
def centerline(spark, sf_dir):
    """The source track of the centre line, for three events."""
    df = trk(spark, sf_dir)
    events = [(0, 50.0, 20.0), (1, 120.0, 60.0), (2, 240.0, 30.0)]
    near = F.filter(F.array(*[F.when(F.hypot(F.col("x") - x, F.col("y") - y) < 15, i) for i, x, y in events]), lambda e: e.isNotNull())
    covered = df.select("track_id", F.explode(near).alias("event"))
    return centerline_pick(windows.path_stats(df).select("track_id", "path"), covered, 100.0).select("track_id", F.round("path", 5).alias("path"), "events")


def _centre_sql() -> str:
    return f"""{TRK}, s AS (SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS step FROM trk WINDOW w AS (PARTITION BY track_id ORDER BY k)),
p AS (SELECT track_id, sum(step) AS path FROM s GROUP BY track_id),
n AS (SELECT s.track_id, count(DISTINCT e.id) AS events FROM trk s JOIN (VALUES (0, 50.0, 20.0), (1, 120.0, 60.0), (2, 240.0, 30.0)) e(id, ex, ey) ON sqrt(power(s.x - ex, 2) + power(s.y - ey, 2)) < 15 GROUP BY s.track_id),
best AS (SELECT track_id FROM p JOIN n USING (track_id) WHERE path > 100 ORDER BY events DESC, p.path DESC, track_id LIMIT 1),
a AS (SELECT track_id, k, x, y, sum(coalesce(step, 0)) OVER (PARTITION BY track_id ORDER BY k) AS arc FROM s WHERE track_id IN (FROM best)),
z AS (SELECT *, lead(arc) OVER w AS arc1, lead(x) OVER w AS x1, lead(y) OVER w AS y1, max(arc) OVER () AS total FROM a WINDOW w AS (ORDER BY k))"""


@query(
    f"""WITH {_centre_sql()} SELECT track_id, i::INT AS i, round(x + (total * i / 39 - arc) / (arc1 - arc) * (x1 - x), 5) AS x, round(y + (total * i / 39 - arc) / (arc1 - arc) * (y1 - y), 5) AS y FROM z, range(39) r(i) WHERE arc1 > arc AND total * i / 39 >= arc AND total * i / 39 < arc1
UNION ALL SELECT track_id, 39, round(x, 5), round(y, 5) FROM z WHERE arc1 IS NULL"""
)
def centerline_points(spark, sf_dir):
    """The centre line: forty places along the source track."""
    df = trk(spark, sf_dir)
    best = centerline(spark, sf_dir).select("track_id")
    return rounded(windows.resample_arc(df.join(F.broadcast(best), "track_id", "left_semi"), 40).drop("s"), 5)


@query(f"WITH {TRK}, s AS (SELECT k, CASE WHEN speed < {LOW} THEN 'stopped' WHEN speed < {HIGH} THEN 'braking' ELSE 'rolling' END AS state FROM trk) SELECT k, count(*) FILTER (state = 'rolling') AS rolling, count(*) FILTER (state = 'braking') AS braking, count(*) FILTER (state = 'stopped') AS stopped FROM s GROUP BY k")
def state_counters(spark, sf_dir):
    return counters(simple_states(trk(spark, sf_dir)))


@query(
    f"""WITH {TRK}, s AS (SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS step FROM trk WINDOW w AS (PARTITION BY track_id ORDER BY k)),
z AS (SELECT track_id, k, sqrt(power(x - first_value(x) OVER f, 2) + power(y - first_value(y) OVER f, 2)) AS chord, coalesce(sum(step) OVER g, 0) AS trail FROM s
  WINDOW f AS (PARTITION BY track_id ORDER BY k ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), g AS (PARTITION BY track_id ORDER BY k ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT track_id, k, round(chord, 5) AS chord, round(trail, 5) AS trail FROM z"""
)
def draw_trails(spark, sf_dir):
    return rounded(trails(trk(spark, sf_dir), 5).select("track_id", "k", "chord", "trail"), 5)


_TURN = "degrees(atan2(ny, nx))"


@query(
    f"""WITH {TRK}, s AS (SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS step FROM trk WINDOW w AS (PARTITION BY track_id ORDER BY k)),
a AS (SELECT track_id, k, x, y, sum(coalesce(step, 0)) OVER (PARTITION BY track_id ORDER BY k) AS arc FROM s),
z AS (SELECT *, lead(arc) OVER w AS arc1, lead(x) OVER w AS x1, lead(y) OVER w AS y1, max(arc) OVER (PARTITION BY track_id) AS total FROM a WINDOW w AS (PARTITION BY track_id ORDER BY k)),
q AS (SELECT track_id, i, x + (total * i / 15 - arc) / (arc1 - arc) * (x1 - x) AS x, y + (total * i / 15 - arc) / (arc1 - arc) * (y1 - y) AS y FROM z, range(15) r(i) WHERE arc1 > arc AND total * i / 15 >= arc AND total * i / 15 < arc1
  UNION ALL SELECT track_id, 15, x, y FROM z WHERE arc1 IS NULL AND total > 0 UNION ALL SELECT track_id, i, x, y FROM z, range(16) r(i) WHERE arc1 IS NULL AND total = 0),
n AS (SELECT track_id, arg_max(x, k) - arg_min(x, k) AS nx, arg_max(y, k) - arg_min(y, k) AS ny FROM trk GROUP BY track_id),
m AS (SELECT track_id, CASE WHEN abs({_TURN}) <= 45 THEN 'straight' WHEN abs({_TURN}) >= 135 THEN 'uturn' WHEN {_TURN} > 0 THEN 'right' ELSE 'left' END AS movement FROM n)
SELECT movement, i::INT AS i, round(quantile_cont(x, 0.5), 5) AS x, round(quantile_cont(y, 0.5), 5) AS y, count(*) AS n FROM q JOIN m USING (track_id) GROUP BY 1, 2 HAVING count(*) >= 3"""
)
def movement_lanes(spark, sf_dir):
    df = trk(spark, sf_dir)
    ends = df.groupBy("track_id").agg(F.min_by(F.struct("x", "y"), "k").alias("a"), F.max_by(F.struct("x", "y"), "k").alias("b"))
    label = g.movement(g.turn_degrees(1.0, 0.0, F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")))
    return rounded(movement_paths(df.join(ends.select("track_id", label.alias("movement")), "track_id"), 16), 5)


@query(
    f"""WITH {TRK}, d AS (SELECT t, CASE WHEN t - lag(t) OVER (ORDER BY t) > 21600 THEN 1 ELSE 0 END AS n FROM trk WHERE cls = 'purchase' AND speed > 200), p AS (SELECT t, sum(n) OVER (ORDER BY t) AS g FROM d),
r AS (SELECT min(t) AS a, max(t) + 7200 AS b FROM p GROUP BY g), f AS (SELECT DISTINCT floor(t / 3600) * 3600.0 AS t FROM trk) SELECT round(f.t, 1) AS t, EXISTS (SELECT 1 FROM r WHERE f.t BETWEEN a AND b) AS green FROM f"""
)
def signal_states(spark, sf_dir):
    """Whether a signal is green at each hour, judged by one approach's few departures."""
    df = trk(spark, sf_dir)
    frames = df.select((F.floor(F.col("t") / 3600) * 3600.0).alias("t")).distinct()
    return rounded(signal_state(df.where("cls = 'purchase' and speed > 200").select("t"), frames, 21600.0, 7200.0), 1)


@query(f"WITH {TRK} SELECT round(min(x), 6) AS x0, round(max(x), 6) AS x1, round(min(y), 6) AS y0, round(max(y), 6) AS y1, round(quantile_cont(speed, 0.02), 6) AS v0, round(quantile_cont(speed, 0.98), 6) AS v1 FROM trk")
def map_extent(spark, sf_dir):
    return rounded(trk(spark, sf_dir).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.percentile("speed", F.lit(0.02)).alias("v0"), F.percentile("speed", F.lit(0.98)).alias("v1")))
