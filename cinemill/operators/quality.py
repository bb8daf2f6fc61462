"""Audits of the input and measures of the output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinemill.session import cut

#: What an audit says about a signal that is missing throughout.
WARNINGS = {"pct_scene_change": "no scene changes", "pct_dialogue": "no dialogue", "pct_image": "no images"}


def signal_audit(packets: DataFrame) -> DataFrame:
    """One row per stream: span, shares of packets with scene changes, dialogue and images, motion, and warnings."""
    pct = lambda c: 100.0 * F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    out = packets.groupBy("video_id").agg(
        ((F.max("timestamp_ms") - F.min("timestamp_ms")) / 1000).alias("total_seconds"),
        pct(F.col("scene_change")).alias("pct_scene_change"),
        pct(F.length("subtitle_text") > 0).alias("pct_dialogue"),
        F.avg("motion_score").alias("mean_motion"),
        F.max("motion_score").alias("max_motion"),
        pct(F.col("has_image")).alias("pct_image"),
    )
    return out.withColumn("warnings", F.array_compact(F.array(*[F.when(F.col(c) == 0, F.lit(w)) for c, w in WARNINGS.items()])))


def event_quality(events: DataFrame, minimum_s: float = 5.0) -> DataFrame:
    """One row per stream: number and durations of events, too short ones, and how many of each type."""
    d = F.col("duration_ms") / 1000
    kinds = [F.count_if(F.col("event_type") == k).alias(f"n_{k.lower()}") for k in ("Dialogue", "Action", "Transition", "Scene")]
    return events.groupBy("video_id").agg(
        F.count("*").alias("n_events"), F.avg(d).alias("avg_s"), F.min(d).alias("min_s"), F.max(d).alias("max_s"), F.count_if(d < minimum_s).alias("short"), *kinds
    )


def fixed_chunks(events: DataFrame, chunk_ms: float = 10_000.0) -> DataFrame:
    """The events of a stream against equal chunks of its length."""
    end = F.max("end_time_ms")
    return events.groupBy("video_id").agg(
        F.count("*").alias("n_events"), (F.avg("duration_ms") / 1000).alias("avg_s"), F.ceil(end / chunk_ms).alias("n_chunks"), (F.lit(chunk_ms) / 1000).alias("chunk_s"), end.alias("coverage_ms")
    )


def sampling_rate(packets: DataFrame) -> DataFrame:
    return packets.groupBy("video_id").agg(F.count("*").alias("kept"), F.round(F.avg("fps_used"), 2).alias("avg_fps"))


def rank_percentile(df: DataFrame, keys: list[str], value: str, share: float = 0.95) -> DataFrame:
    """``keys, n, value_at``: the element at place ``int(n * share)`` (from 0) of a group's sorted values."""
    # Equal values are counted, then sorted into ranges of about equal size; a group may take many ranges.
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    rows = cut(counts.repartitionByRange(*keys, "_v").withColumn("_r", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy(*keys, "_r").agg(F.sum("_c").alias("_t")).withColumn("_b", F.coalesce(F.sum("_t").over(before), F.lit(0)))
    ranges = ranges.withColumn("n", F.sum("_t").over(Window.partitionBy(*keys)))
    at = F.floor(F.col("n") * share)
    ranges = ranges.filter((F.col("_b") <= at) & (at < F.col("_b") + F.col("_t")))
    # Only the range that holds the place is looked through.
    hit = rows.alias("r").join(ranges.alias("g"), reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}")) for c in [*keys, "_r"]]))
    hit = hit.select(*[F.col(f"r.{c}").alias(c) for c in keys], "r._v", "r._c", "g._b", "g.n")
    upto = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    hit = hit.withColumn("_u", F.col("_b") + F.sum("_c").over(upto)).filter((F.col("_u") - F.col("_c") <= at) & (at < F.col("_u")))
    return hit.select(*keys, F.col("n").cast("int").alias("n"), F.col("_v").alias("value_at"))


def boundary_matches(predicted: DataFrame, truth: DataFrame, tolerance_ms: float = 2000.0) -> DataFrame:
    """One row per stream: precision, recall and F1 of predicted boundaries (video_id, at) against true ones.

    In order of time each prediction takes the first free true boundary within the tolerance; they meet in buckets as
    wide as that, and the fold over the candidates of a stream runs inside the JVM.
    """
    bucket = lambda c: F.floor(F.col(c) / tolerance_ms)
    near = predicted.select("video_id", F.col("at").alias("p")).distinct().withColumn("b", F.explode(F.sequence(bucket("p") - 1, bucket("p") + 1)))
    cands = near.join(truth.select("video_id", F.col("at").alias("t")).withColumn("b", bucket("t")), ["video_id", "b"])
    cands = cands.filter(F.abs(F.col("p") - F.col("t")) <= tolerance_ms).groupBy("video_id", "p").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    lists = cands.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("p", "ts"))).alias("a"))
    free = lambda used, x: F.get(F.filter(x["ts"], lambda t: ~F.array_contains(used, t)), F.lit(0))
    used = F.aggregate("a", F.array().cast("array<double>"), lambda u, x: F.when(free(u, x).isNotNull(), F.array_append(u, free(u, x))).otherwise(u))
    hits = lists.select("video_id", F.size(used).alias("tp"))
    n = predicted.groupBy("video_id").agg(F.count("*").alias("n")).join(truth.groupBy("video_id").agg(F.count("*").alias("m")), "video_id", "full")
    rows = n.join(hits, "video_id", "left").select("video_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"), F.coalesce("tp", F.lit(0)).alias("tp"))
    p, r = F.when(F.col("n") > 0, F.col("tp") / F.col("n")).otherwise(0.0), F.when(F.col("m") > 0, F.col("tp") / F.col("m")).otherwise(0.0)
    rows = rows.withColumns({"precision": p, "recall": r})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return rows.withColumns({"f1": F.round(f1, 4), "precision": F.round("precision", 4), "recall": F.round("recall", 4)})
