"""Mixing sources to target weights by hierarchical budgeting. Built-in functions only.

Documents are leaves of a tree domain - language - source. The token budget goes down the
tree by weights; a child never gets more than its documents hold in ``max_epochs`` epochs,
and what it can't take goes to its siblings first (by their weights), and only when all of
them are full to those of its parent. Each leaf then takes whole epochs and, of one more
epoch in seeded order, the documents whose tokens, summed in that order, fit its budget.

The prefix of a leaf is found without sorting the leaf: tokens are summed in 4096 buckets
of the order key, then in 4096 parts of the one bucket where the budget ends; only the
documents of one such part are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspark.llm.common import SPACE_WORD, stored

SEED = 17
MAX_EPOCHS = 2
SHARE = 0.5
LEVELS = ("domain", "lang", "source")
#: Weights of domains; languages and sources weigh 1 each unless a table says otherwise.
DOMAIN_WEIGHTS = {"core": 2.0, "wide": 1.0}


def domain_of(source: Column) -> Column:
    """The domain of a source: by the first hex digit of its MD5."""
    return F.when(F.substring(F.md5(source.cast("binary")), 1, 1) < "8", "core").otherwise("wide")


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def shares(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Budgets of children: ``nodes`` has the columns ``parent``, ``child``, ``weight``, ``room`` and ``budget`` (of the parent).

    Water filling: the level at which the children, each up to its room, take the budget.
    Children are full in the order of room over weight; weight 0 gets nothing.
    """
    ratio = F.when(F.col("weight") > 0, F.col("room") / F.col("weight")).otherwise(float("inf"))
    nodes = nodes.withColumn("__r", ratio)
    by = Window.partitionBy(*parent).orderBy("__r", child)
    before, total = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*parent)
    nodes = nodes.withColumn("__full", F.coalesce(F.sum("room").over(before), F.lit(0))).withColumn("__left", F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # the level if all before this child are full and it and all after it aren't; it holds from the first child on
    # that it doesn't fill, and counting that one as full too only lowers it
    nodes = nodes.withColumn("__level", F.when(F.col("__left") > 1e-12, (F.col("budget") - F.col("__full")) / F.col("__left")))
    level = F.max(F.when(F.col("__level") <= F.col("__r"), F.col("__level"))).over(total)
    given = F.when(F.col("weight") <= 0, 0).when(level.isNull(), F.col("room")).otherwise(F.least(F.col("room"), F.floor(F.round(level * F.col("weight"), 6))))
    return nodes.withColumn("given", F.greatest(F.lit(0), given).cast("long")).drop("__r", "__full", "__left", "__level")


def _leaves(docs: DataFrame) -> DataFrame:
    return docs.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("n"))


def budgets(leaves: DataFrame, budget: Column, max_epochs: int = MAX_EPOCHS, weights: DataFrame | None = None) -> DataFrame:
    """``given`` tokens for each leaf (``LEVELS`` and its tokens ``n``); ``weights`` may have rows (path, weight), path as domain/lang/source."""
    spark = leaves.sparkSession
    if weights is None:
        weights = spark.createDataFrame([(k, v) for k, v in DOMAIN_WEIGHTS.items()], "path string, weight double")
    weights = weights.select(F.col("path").alias("__path"), F.col("weight").cast("double").alias("__w"))
    nodes = leaves.withColumn("room", F.col("n") * max_epochs)
    out = nodes.groupBy().agg(F.sum("room").alias("room"), budget.cast("long").alias("budget"))
    given = None
    for depth, name in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        level = nodes.groupBy(*path).agg(F.sum("room").alias("room")).withColumn("__p", F.concat_ws("/", *path))
        level = level.join(weights, F.col("__p") == F.col("__path"), "left").withColumn("weight", F.greatest(F.coalesce("__w", F.lit(1.0)), F.lit(0.0))).drop("__p", "__path", "__w")
        if given is None:
            level = level.join(F.broadcast(out.select("budget")), how="cross").withColumn("__top", F.lit(0))
            given = shares(level, ["__top"], name)
        else:
            level = level.join(given.select(*path[:-1], F.col("given").alias("budget")), path[:-1])
            given = shares(level, path[:-1], name)
        given = given.select(*path, "given")
    return given


def _order(epoch: Column, id_col: str) -> Column:
    """Hex digits whose order is the seeded order of the epoch."""
    return F.md5(F.concat(F.lit(f"{SEED}:"), epoch.cast("string"), F.lit(":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, max_epochs: int = MAX_EPOCHS, weights: DataFrame | None = None, carry: list[str] | None = None) -> DataFrame:
    """The selected documents, one row per document and epoch: ``carry`` columns, ``domain``, ``n_tokens`` and ``epoch`` (from 1).

    The budget is ``share`` of all tokens. Null languages and sources are nodes named
    ``(null)`` in the tree (and stay null in the rows); documents without tokens come with
    their epoch but need no budget. Rows of one id share their place in the order and are
    taken together by the sums before them, then by their tokens. A budget below the first
    document's tokens selects nothing of the leaf; an empty table gives no rows.
    """
    carry = carry or [id_col, "lang", "source"]
    base = docs.select(*[F.col(c).alias(f"c_{c}") for c in carry], F.col(id_col).alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("(null)")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("(null)")).alias("source"), tokens(F.col(text_col)).alias("n_tokens"))
    base = base.withColumn("domain", domain_of(F.col("source")))
    small = stored(base.select("id", *LEVELS, "n_tokens"))
    leaves = _leaves(small)
    plan = budgets(leaves, F.floor(F.sum("n") * F.lit(share)), max_epochs, weights)
    whole = F.when(F.col("n") > 0, F.floor(F.col("given") / F.col("n"))).otherwise(0).cast("int")
    plan = stored(leaves.join(plan, list(LEVELS)).withColumn("whole", whole).withColumn("rest", F.col("given") - F.col("whole") * F.col("n")))

    def placed(df):
        df = df.join(plan.select(*LEVELS, "whole", "rest"), list(LEVELS))
        return df.withColumn("key", _order(F.col("whole") + 1, "id")).withColumn("b1", F.substring("key", 1, 3)).withColumn("b2", F.substring("key", 4, 3))

    rows = placed(small)
    by_bucket = Window.partitionBy(*LEVELS).orderBy("b1")
    first = rows.groupBy(*LEVELS, "b1").agg(F.first("rest").alias("rest"), F.sum("n_tokens").alias("s")).withColumn("upto", F.sum("s").over(by_bucket))
    cut1 = first.where("upto > rest").groupBy(*LEVELS).agg(F.min_by(F.struct("b1", (F.col("upto") - F.col("s")).alias("before")), "b1").alias("c")).select(*LEVELS, F.col("c.b1").alias("cut1"), F.col("c.before").alias("before1"))
    by_part = Window.partitionBy(*LEVELS).orderBy("b2")
    inner = rows.join(cut1, list(LEVELS)).where("b1 = cut1").groupBy(*LEVELS, "b2").agg(F.first("rest").alias("rest"), F.first("before1").alias("before1"), F.sum("n_tokens").alias("s")).withColumn("upto", F.col("before1") + F.sum("s").over(by_part))
    cut2 = inner.where("upto > rest").groupBy(*LEVELS).agg(F.min_by(F.struct("b2", (F.col("upto") - F.col("s")).alias("before")), "b2").alias("c")).select(*LEVELS, F.col("c.b2").alias("cut2"), F.col("c.before").alias("before2"))
    cuts = stored(plan.join(cut1, list(LEVELS), "left").join(cut2, list(LEVELS), "left").select(*LEVELS, "whole", "rest", "cut1", "cut2", "before2"))

    every = base.join(cuts, list(LEVELS)).withColumn("key", _order(F.col("whole") + 1, "id")).withColumn("b1", F.substring("key", 1, 3)).withColumn("b2", F.substring("key", 4, 3))
    below = F.col("cut1").isNull() | (F.col("b1") < F.col("cut1")) | ((F.col("b1") == F.col("cut1")) & (F.col("b2") < F.col("cut2")))
    edge = F.coalesce((F.col("b1") == F.col("cut1")) & (F.col("b2") == F.col("cut2")), F.lit(False))
    extra = F.when(F.coalesce(below, F.lit(False)) & (F.col("rest") > 0), 1).otherwise(0)
    sure = every.where(~edge).withColumn("epochs", F.col("whole") + extra)
    # one part of one bucket of each leaf
    ordered = Window.partitionBy(*LEVELS).orderBy("key", "n_tokens", "id").rowsBetween(Window.unboundedPreceding, 0)
    last = every.where(edge).withColumn("epochs", F.col("whole") + F.when((F.col("before2") + F.sum("n_tokens").over(ordered) <= F.col("rest")) & (F.col("rest") > 0), 1).otherwise(0))
    taken = sure.unionByName(last).where("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("epochs"))))
    return taken.select(*[F.col(f"c_{c}").alias(c) for c in carry], "domain", "n_tokens", "epoch")
