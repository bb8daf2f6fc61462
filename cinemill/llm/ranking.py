"""One ranking from several differently-scaled scores, by distance to the ideal point.

Within a group each score is winsorised, divided by the length of its vector over the group and
weighted; an item's closeness is its distance to the anti-ideal point through the sum of its distances
to both points. Everything per group is an aggregate with map-side combine, and ranks come from counts
of values in sorted ranges, so a group that holds a third of all rows is never one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinemill.session import cut, free_name


def _same(a: str, b: str, columns: list[str]) -> Column:
    """The columns agree in both aliases, NULL with NULL."""
    out = F.lit(True)
    for c in columns:
        out &= F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def _long(df: DataFrame, groups: list[str], scores: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col(s).cast("double").alias("x")) for i, s in enumerate(scores)])
    return df.select(*groups, F.inline(pairs))


def values_above(df: DataFrame, groups: list[str], scores: list[str]) -> DataFrame:
    """``groups``, ``i``, ``x``, ``above``: the number of rows of the group with a larger i-th score than x.

    Equal values are counted before any shuffle, then sorted into ranges of about equal size whatever their
    distribution (a group may take many ranges); the sums of the ranges and ranks inside one add up.
    """
    counts = _long(df, groups, scores).groupBy(*groups, "i", "x").agg(F.count("*").alias("n"))
    by = [*groups, "i"]
    # Written once: which range a value falls into must not change between the two branches.
    binned = cut(counts.repartitionByRange(*by, "x").withColumn("bin", F.spark_partition_id()))
    sums = binned.groupBy(*by, "bin").agg(F.sum("n").alias("m"))
    higher = Window.partitionBy(*by).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("over", F.coalesce(F.sum("m").over(higher), F.lit(0)))
    inside = Window.partitionBy(*by, "bin").orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, -1)
    binned = binned.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return binned.alias("b").join(sums.alias("s"), _same("b", "s", [*by, "bin"])).select(
        *[f"b.{g}" for g in by], "b.x", (F.col("s.over") + F.col("b.within")).alias("above")
    )


def _closeness(values: list[Column], i_stats: list[str], weights: list[float]) -> Column:
    """Relative closeness of a point, with the group's statistics as columns low{i}, high{i}, norm{i}."""
    best = worst = F.lit(0.0)
    for k, (x, w) in enumerate(zip(values, weights)):
        low, high, norm = (F.col(f"{s}{k}") for s in i_stats)
        clipped = F.least(F.greatest(x, low), high)
        scale = F.when(norm > 0, F.lit(float(w)) / norm).otherwise(0.0)
        best = best + F.pow((high - clipped) * scale, 2)
        worst = worst + F.pow((clipped - low) * scale, 2)
    best, worst = F.sqrt(best), F.sqrt(worst)
    return F.when(best + worst > 0, worst / (best + worst)).otherwise(0.5)


def ideal_point_ranking(
    df: DataFrame,
    groups: list[str],
    ids: list[str],
    scores: list[str],
    *,
    weights: list[float] | None = None,
    winsor: tuple[float, float] = (0.05, 0.95),
    top_share: float = 0.2,
    least_group: int = 1,
) -> DataFrame:
    """``groups, ids, scores, group_size, closeness, place, can_top, in_top``; a row per item.

    ``place`` is 1 plus the number of items of the group with a larger closeness. ``in_top``: in each
    score fewer than ``top_share`` of the group lie strictly above. ``can_top``: the closeness reaches that
    of the point that just passes in every score; as closeness never falls when a score rises, no item in
    the top lacks it. Winsor limits are the group's exact quantiles (the least value that so large a share doesn't
    exceed). ``closeness`` is rounded to nine places, so that its place doesn't hang on the order of sums.

    An item with a NULL or NaN score is left out, as are groups of fewer than ``least_group`` items. Equal
    items share their place. A score that is constant in its group adds nothing to any distance; if all
    are, closeness is 0.5. Rows that repeat ``groups`` and ``ids`` count once, with the smallest scores.
    NULL group keys form a group of their own. Result columns whose name is taken get an underscore.
    """
    k = len(scores)
    weights = [1.0 / k] * k if weights is None else [w / sum(weights) for w in weights]
    g, d, v = [f"g{i}" for i in range(len(groups))], [f"d{i}" for i in range(len(ids))], [f"v{i}" for i in range(k)]
    items = df.select(
        *[F.col(c).alias(a) for c, a in zip(groups, g)],
        *[F.col(c).alias(a) for c, a in zip(ids, d)],
        *[F.col(c).cast("double").alias(a) for c, a in zip(scores, v)],
    )
    for c in v:
        items = items.filter(F.col(c).isNotNull() & ~F.isnan(c))
    items = cut(items.groupBy(*g, *d).agg(F.min(F.struct(*v)).alias("v")).select(*g, *d, *[f"v.{c}" for c in v]))

    sizes = items.groupBy(*g).agg(F.count("*").alias("size")).filter(F.col("size") >= least_group)
    above = values_above(items, g, v).alias("a").join(sizes.alias("s"), _same("a", "s", g)).select(*[f"a.{c}" for c in g], "a.i", "a.x", "a.above", "s.size")
    upto = F.col("size") - F.col("above")  # rows with at most x
    of = lambda i, good: F.min(F.when((F.col("i") == i) & good, F.col("x")))
    limits = [of(i, upto >= F.col("size") * q - 1e-9).alias(f"{e}{i}") for e, q in zip(("low", "high"), winsor) for i in range(k)]
    passing = [of(i, F.col("above") < F.col("size") * top_share - 1e-9).alias(f"pass{i}") for i in range(k)]
    stats = cut(above.groupBy(*g).agg(F.max("size").alias("size"), *limits, *passing))
    with_limits = items.alias("t").join(stats.alias("s"), _same("t", "s", g)).select(
        *[f"t.{c}" for c in [*g, *d, *v]], "s.size", *[f"s.{e}{i}" for e in ("low", "high", "pass") for i in range(k)]
    )
    norms = with_limits.groupBy(*g).agg(
        *[F.sqrt(F.sum(F.pow(F.least(F.greatest(F.col(c), F.col(f"low{i}")), F.col(f"high{i}")), 2))).alias(f"norm{i}") for i, c in enumerate(v)]
    )
    joined = with_limits.alias("t").join(norms.alias("n"), _same("t", "n", g)).select(
        *[f"t.{c}" for c in with_limits.columns], *[f"n.norm{i}" for i in range(k)]
    )
    parts = ["low", "high", "norm"]
    passed = F.lit(True)
    for i, c in enumerate(v):
        passed &= F.col(c) >= F.col(f"pass{i}")
    ranked = cut(
        joined.withColumn("closeness", F.round(_closeness([F.col(c) for c in v], parts, weights), 9))
        .withColumn("can_top", F.col("closeness") >= _closeness([F.col(f"pass{i}") for i in range(k)], parts, weights) - 2e-9)
        .withColumn("in_top", F.col("can_top") & passed)
        .select(*g, *d, *v, "size", "closeness", "can_top", "in_top")
    )
    places = values_above(ranked, g, ["closeness"])
    out = ranked.alias("r").join(places.alias("p"), _same("r", "p", g) & (F.col("r.closeness") == F.col("p.x")))
    taken, final = [*groups, *ids, *scores], []
    for src, name in (("r.size", "group_size"), ("r.closeness", "closeness"), (None, "place"), ("r.can_top", "can_top"), ("r.in_top", "in_top")):
        final.append((F.col(src) if src else F.col("p.above") + 1).alias(free_name(name, taken)))
    return out.select(*[F.col(f"r.{a}").alias(c) for c, a in zip(taken, [*g, *d, *v])], *final)
