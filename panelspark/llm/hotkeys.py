"""A join to one row for each key, in which no task gets more than a small share of a hot key's rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys from this share of all rows on are hot; so there are at most 1,000 of them.
HOT_SHARE = 0.001


def join_said(rows: DataFrame, said: DataFrame, keys: list[str], hot: Column | str) -> DataFrame:
    """``rows`` and the other columns of ``said`` (one row for each of ``keys``, null is a
    key). ``hot`` marks keys of ``said`` with :data:`HOT_SHARE` of all rows or more:
    these go to all tasks, the others meet their rows in a shuffle. Rows without
    a key in ``said`` are dropped. Both inputs are read twice: written tables."""
    other = [c for c in said.columns if c not in keys]
    known = said.select(F.struct(*keys).alias("key_said"), F.struct(*other).alias("said"), (F.expr(hot) if isinstance(hot, str) else hot).alias("is_hot"))
    meets = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"key_said.{k}")) for k in keys))
    near = F.broadcast(known.where("is_hot"))
    far = rows.join(near.select("key_said"), meets, "left_anti").join(known.where("NOT is_hot"), meets)
    return rows.join(near, meets).select(*rows.columns, "said.*").unionAll(far.select(*rows.columns, "said.*"))
