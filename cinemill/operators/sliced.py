"""Window functions over one hot key, in slices.

A window over (key) puts a whole stream into one task. Here it runs over (key, slice); the few rows at the
edges of the slices, and one total per slice, are all that a window over the key alone ever sees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(df: DataFrame, key: str, order: list[str], slice_: Column, *, back: int = 1, ahead: int = 0, carry: list[str] | None = None) -> DataFrame:
    """``df`` with ``prev1..prevN`` and ``next1..nextN``: structs of the ``carry`` columns (all, if not given) of
    the rows before and after in ``order`` within ``key``; NULL where there are none.

    ``order`` should order the rows of a key fully, and ``slice_`` must not fall along it.
    """
    carry = carry or df.columns
    rows = df.withColumns({"_slice": slice_, "_r": F.struct(*carry)})
    inside = Window.partitionBy(key, "_slice").orderBy(*order)
    names = [(f"prev{i}", F.lag, i) for i in range(1, back + 1)] + [(f"next{i}", F.lead, i) for i in range(1, ahead + 1)]
    rows = rows.withColumns({n: f("_r", i).over(inside) for n, f, i in names} | {"_first": F.row_number().over(inside)})
    rows = rows.withColumn("_last", F.row_number().over(Window.partitionBy(key, "_slice").orderBy(*[F.desc(c) for c in order])))
    reach = max(back, ahead)
    middle = rows.filter((F.col("_first") > reach) & (F.col("_last") > reach))
    edges = rows.filter((F.col("_first") <= reach) | (F.col("_last") <= reach))
    # Among edge rows a neighbour is right if it comes from the same end of the slice or the slice next to it.
    across = Window.partitionBy(key).orderBy("_slice", *order)
    fixed = {}
    for n, f, i in names:
        near = F.col("_first") <= i if f is F.lag else F.col("_last") <= i
        fixed[n] = F.when(near, f("_r", i).over(across)).otherwise(F.col(n))
    edges = edges.select(*[c for c in edges.columns if c not in fixed], *[x.alias(n) for n, x in fixed.items()])
    return middle.unionByName(edges).drop("_slice", "_r", "_first", "_last")


def running_sum(df: DataFrame, key: str, order: list[str], slice_: Column, value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the key's rows up to and including each in ``order``."""
    rows = df.withColumns({"_slice": slice_, "_v": value})
    totals = rows.groupBy(key, "_slice").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(key, "_slice", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(key, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_own", F.sum("_v").over(inside)).join(totals, [key, "_slice"])
    return rows.withColumn(name, F.col("_before") + F.col("_own")).drop("_slice", "_v", "_own", "_before")


def running_max(df: DataFrame, key: str, order: list[str], slice_: Column, value: Column, name: str) -> DataFrame:
    """``df`` with the largest value over the key's rows before each in ``order``; NULL without any."""
    rows = df.withColumns({"_slice": slice_, "_v": value})
    most = rows.groupBy(key, "_slice").agg(F.max("_v").alias("_t"))
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    most = most.select(F.col(key).alias("_k"), F.col("_slice").alias("_s"), F.max("_t").over(before).alias("_before"))
    inside = Window.partitionBy(key, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.max("_v").over(inside)).join(most, F.col(key).eqNullSafe(F.col("_k")) & F.col("_slice").eqNullSafe(F.col("_s")))
    return rows.withColumn(name, F.greatest("_before", "_own")).drop("_slice", "_v", "_own", "_before", "_k", "_s")
