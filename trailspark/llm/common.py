"""What several operators share: tables that cut lineage, connected components, and salted lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.operators.graph import connected_components
from trailspark.operators.lineage import python_workers, shared_dir, stored

__all__ = ["SPACE_WORD", "connected_components", "fresh", "let", "looked_up", "python_workers", "shared_dir", "stored"]

#: Words of contracts that split on ASCII space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
SALTS = 32


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores added until no column of the frames is called so."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def looked_up(rows: DataFrame, key: str, few: DataFrame, few_key: str, how: str = "left") -> DataFrame:
    """``rows`` joined to the (few) rows of ``few`` by key, each copied to ``SALTS`` places, so that a key with very many rows is dealt out."""
    salt, place = fresh("__salt", rows, few), fresh("__place", rows, few)
    rows = rows.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    few = few.withColumn(place, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(few, (F.col(key) == F.col(few_key)) & (F.col(salt) == F.col(place)), how).drop(salt, place, few_key)


def let(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` and its lambdas use it."""
    return F.transform(F.array(value), f)[0]
