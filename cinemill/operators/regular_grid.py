"""Irregular readings onto a regular grid.

Consecutive readings of a source are paired with ``lead``; only the grid times between the two
readings of a pair are exploded and interpolated or marked there and then, so the work follows the
size of the output and no calendar is joined. A source is cut into time slices, so that one hot
source spreads over many tasks: pairs inside a slice come from a window over (source, slice), pairs
across slices from a window over the two edge readings of each slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OBSERVED, INTERPOLATED, MISSING, EDGE = "observed", "interpolated", "missing", "edge"
#: Grid times are exploded in two steps of at most this many each, so one huge hole needs no huge array.
BLOCK = 4096


def _pairs(readings: DataFrame, order: list[str]) -> DataFrame:
    """Each reading with the next one of its source in ``nxt``; columns _source, _slice, and a struct r."""
    by_slice = Window.partitionBy("_source", "_slice").orderBy(*[f"r.{c}" for c in order])
    tagged = readings.select(
        "_source", "_slice", "r", F.lead("r").over(by_slice).alias("nxt"), F.lag(F.lit(True)).over(by_slice).isNull().alias("first")
    )
    inside = tagged.filter(F.col("nxt").isNotNull()).select("_source", "r", "nxt")
    edges = tagged.filter(F.col("nxt").isNull() | F.col("first"))
    across = Window.partitionBy("_source").orderBy("_slice", *[f"r.{c}" for c in order])
    edges = edges.select("_source", "_slice", "r", "nxt", F.lead("r").over(across).alias("over"))
    return inside.unionByName(
        edges.filter(F.col("nxt").isNull() & F.col("over").isNotNull()).select("_source", "r", F.col("over").alias("nxt"))
    )


def _explode_range(df: DataFrame, low: Column, high: Column, name: str) -> DataFrame:
    """A row for every whole number from ``low`` to ``high``; none if ``high`` < ``low``."""
    span = F.floor((high - low) / BLOCK)
    blocks = df.withColumns({"_low": low, "_high": high}).filter(high >= low)
    blocks = blocks.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), span.cast("long"))))
    start = F.col("_low") + F.col("_block") * BLOCK
    return blocks.withColumn(name, F.explode(F.sequence(start, F.least(F.col("_high"), start + BLOCK - 1)))).drop("_low", "_high", "_block")


def regular_grid(
    df: DataFrame,
    source: str,
    time_ms: str,
    values: list[str],
    *,
    key: str | None = None,
    usable: Column | None = None,
    rate: str | None = None,
    step_ms: int = 1000,
    max_periods: float = 4.0,
    max_gap_ms: float | None = None,
    bounds: DataFrame | None = None,
    slice_ms: int = 3_600_000,
) -> DataFrame:
    """One row per ``source`` and grid step: ``(source, step, status, <values>)``.

    A step is ``floor(time_ms / step_ms)``. ``status`` is ``observed`` (the mean of the step's
    readings), ``interpolated`` (linear between the readings around a short gap, taken at the middle of
    the step), ``missing`` (inside a hole; values NULL) or ``edge`` (before the first or after the last
    reading, only where ``bounds`` asks for it; values NULL). A gap between two neighbouring readings is
    a hole if it is longer than ``max_gap_ms``, or than ``max_periods`` sampling periods of the slower
    reading (``1000 / rate``) if ``rate`` names a column.

    ``bounds(source, first_step, last_step)`` extends every listed source to its boundaries, also a
    source without any usable reading.

    Readings with NULL or NaN time, or for which ``usable`` isn't true, are left out. A NULL, NaN or
    non-positive rate gives no period; if both readings lack one there is no hole. NULL sources form a
    source of their own. NULL or NaN values are left out of means; an interpolated value is NULL if
    either neighbour's is. Rows that repeat (source, ``key``) count once; without ``key`` repeated
    readings change nothing but the mean's weights. Readings at equal times follow their ``key``. An
    empty table gives no rows but those of ``bounds``. Other columns are ignored, whatever their names.
    """
    if max_gap_ms is None and rate is None:
        raise ValueError("give max_gap_ms or rate")
    t = F.col(time_ms).cast("double")
    fields = [t.alias("t"), (F.col(key) if key else F.lit(None).cast("long")).alias("k")]
    if rate is not None:
        r = F.col(rate).cast("double")
        fields.append(F.when((r > 0) & ~F.isnan(r), 1000.0 / r).alias("period"))
    for i, v in enumerate(values):
        x = F.col(v).cast("double")
        fields.append(F.when(~F.isnan(x), x).alias(f"v{i}"))
    good = t.isNotNull() & ~F.isnan(t) & (F.abs(t) < 1e18)
    if usable is not None:
        good &= usable
    readings = df.filter(good).select(
        F.col(source).alias("_source"), F.floor(t / slice_ms).alias("_slice"), F.struct(*fields).alias("r")
    )
    readings = readings.repartition("_source", "_slice")
    if key:
        readings = readings.withColumn("_k", F.col("r.k")).dropDuplicates(["_source", "_slice", "_k"]).drop("_k")

    step = lambda c: F.floor(F.col(c) / step_ms)
    observed = readings.groupBy("_source", "_slice", step("r.t").alias("step")).agg(
        *[F.avg(f"r.v{i}").alias(f"v{i}") for i in range(len(values))]
    )
    observed = observed.select("_source", "step", F.lit(OBSERVED).alias("status"), *[f"v{i}" for i in range(len(values))])

    gap = F.col("nxt.t") - F.col("r.t")
    limit = F.lit(float(max_gap_ms)) if max_gap_ms is not None else F.greatest("r.period", "nxt.period") * max_periods
    # Plain columns before the explode: Catalyst doesn't need to look for nested fields behind it.
    n = range(len(values))
    between = _pairs(readings, ["t", "k"]).select(
        "_source",
        F.col("r.t").alias("t"),
        gap.alias("gap"),
        F.coalesce(gap > limit, F.lit(False)).alias("hole"),
        (step("r.t") + 1).alias("low"),
        (step("nxt.t") - 1).alias("high"),
        *[F.col(f"r.v{i}").alias(f"a{i}") for i in n],
        *[F.col(f"nxt.v{i}").alias(f"b{i}") for i in n],
    )
    between = _explode_range(between, F.col("low"), F.col("high"), "step")
    at = ((F.col("step") + 0.5) * step_ms - F.col("t")) / F.col("gap")
    between = between.select(
        "_source",
        "step",
        F.when(F.col("hole"), MISSING).otherwise(INTERPOLATED).alias("status"),
        *[F.when(~F.col("hole"), F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * at).alias(f"v{i}") for i in n],
    )
    out = observed.unionByName(between)
    if bounds is not None:
        ends = readings.groupBy("_source").agg(F.min(step("r.t")).alias("_a"), F.max(step("r.t")).alias("_b"))
        asked = bounds.select(
            F.col(source).alias("_source"), F.col("first_step").cast("long").alias("_from"), F.col("last_step").cast("long").alias("_to")
        ).filter("_from is not null and _to is not null")
        asked = asked.groupBy("_source").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to")).alias("asked")
        both = asked.join(ends.alias("ends"), F.expr("asked._source <=> ends._source"), "left").select("asked._source", "_from", "_to", "_a", "_b")
        before = _explode_range(both, F.col("_from"), F.least(F.col("_a") - 1, F.col("_to")), "step")
        after = _explode_range(both, F.greatest(F.col("_from"), F.coalesce(F.col("_b") + 1, F.col("_from"))), F.col("_to"), "step")
        nothing = [F.lit(None).cast("double").alias(f"v{i}") for i in range(len(values))]
        edge = before.filter("_a is not null").unionByName(after).select("_source", "step", F.lit(EDGE).alias("status"), *nothing)
        out = out.unionByName(edge)
    return out.select(
        F.col("_source").alias(source), F.col("step").cast("long").alias("step"), "status", *[F.col(f"v{i}").alias(v) for i, v in enumerate(values)]
    )
