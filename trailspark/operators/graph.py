"""Connected components, and the grids whose cells they join."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailspark.functions.geometry import angle_gap
from trailspark.operators.lineage import stored


def _settled(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1] or 0


def _toward_least(pairs: DataFrame) -> DataFrame:
    """For rows (u, v) the rows (u, v, m), m the least of u and all its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return pairs.join(least, F.col("u") == F.col("w")).select("u", "v", "m")


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the undirected ``edges (u, v)``; root is the least node of its component.

    Large-star and small-star steps take turns until nothing changes; each turn is
    written to the shared folder. Minima are pre-aggregated, so a node with very many
    links is no hot group. Loops and repeated links are harmless; no links, no rows.
    """
    current = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while (now := _settled(current)) != before and now[0]:
        before = now
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        near = _toward_least(large)
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        current = stored(small.where("u <> v").distinct())
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def flow_grid(samples: DataFrame, cell: float, key: str = "track_id", order: str = "k") -> DataFrame:
    """Per grid cell the number of steps that start in it and their summed motion: cx, cy, hits, dx, dy."""
    w = Window.partitionBy(key).orderBy(order)
    steps = samples.select(F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"), (F.lead("x").over(w) - F.col("x")).alias("dx"), (F.lead("y").over(w) - F.col("y")).alias("dy"))
    return steps.where("dx is not null").groupBy("cx", "cy").agg(F.count("*").alias("hits"), F.sum("dx").alias("dx"), F.sum("dy").alias("dy"))


def _cell_id(cx, cy):
    return F.shiftleft(cx.cast("long") + F.lit(1 << 30), 31) + cy.cast("long") + F.lit(1 << 30)


def _neighbours(cells: DataFrame, extra: list[str], eight: bool) -> DataFrame:
    """Pairs of adjacent cells, each once: ``cells`` has cx, cy and ``extra``; an equi-join on the shifted place."""
    steps = [(1, 0), (0, 1), (1, 1), (1, -1)] if eight else [(1, 0), (0, 1)]
    shift = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps]))
    left = cells.select("cx", "cy", *extra, shift.alias("s")).select((F.col("cx") + F.col("s.a")).alias("nx"), (F.col("cy") + F.col("s.b")).alias("ny"), "cx", "cy", *[F.col(c).alias(f"{c}_u") for c in extra])
    right = cells.select(F.col("cx").alias("vx"), F.col("cy").alias("vy"), *[F.col(c).alias(f"{c}_v") for c in extra])
    return left.join(right, (F.col("nx") == F.col("vx")) & (F.col("ny") == F.col("vy")))


def _labelled(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """``cells`` with ``root``, the least cell of their component, and its ``size``."""
    edges = pairs.select(_cell_id(F.col("cx"), F.col("cy")).alias("u"), _cell_id(F.col("vx"), F.col("vy")).alias("v"))
    roots = connected_components(edges)
    rows = cells.withColumn("id", _cell_id(F.col("cx"), F.col("cy"))).join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id")).drop("node", "id")
    sizes = rows.groupBy("root").agg(F.count("*").alias("size"))
    return rows.join(sizes, "root")


def road_components(grid: DataFrame, min_hits: int, max_angle_deg: float, min_cells: int) -> DataFrame:
    """Cells with enough hits and net motion over 1, joined to their eight neighbours of like direction; components of ``min_cells`` or more, numbered by size."""
    cells = grid.where((F.col("hits") >= min_hits) & (F.hypot("dx", "dy") > 1)).select("cx", "cy", "hits", F.atan2("dy", "dx").alias("way"))
    pairs = _neighbours(cells, ["way"], eight=True).where(angle_gap(F.col("way_u"), F.col("way_v")) < math.radians(max_angle_deg))
    return ranked(_labelled(cells, pairs).where(F.col("size") >= min_cells))


def ranked(labelled: DataFrame) -> DataFrame:
    """``labelled`` with ``component``: components by size, the largest first, then by their least cell. The window is over components."""
    places = labelled.select("root", "size").distinct().withColumn("component", F.row_number().over(Window.orderBy(F.desc("size"), "root")))
    return labelled.join(places.drop("size"), "root")


def grid_components(cells: DataFrame) -> DataFrame:
    """Components of cells (cx, cy) under their four neighbours. The cells are stored first, so that what they are made from is read once."""
    cells = stored(cells.select("cx", "cy"))
    return _labelled(cells, _neighbours(cells, [], eight=False))


def largest_component(labelled: DataFrame) -> DataFrame:
    """The cells of the largest component; of equally large ones that with the least cell."""
    best = labelled.groupBy("root").agg(F.count("*").alias("n")).agg(F.max_by("root", F.struct("n", -F.col("root"))).alias("best"))
    return labelled.join(F.broadcast(best), F.col("root") == F.col("best"), "left_semi")


def component_front(cells: DataFrame, upper: bool, min_rows: int = 3) -> DataFrame:
    """Per time column (cx) with ``min_rows`` cells or more the upper or lower end (cy)."""
    edge = F.max("cy") if upper else F.min("cy")
    return cells.groupBy("cx").agg(F.count("*").alias("n"), edge.alias("cy")).where(F.col("n") >= min_rows).select("cx", "cy")
