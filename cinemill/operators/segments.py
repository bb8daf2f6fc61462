"""From boundary decisions to events: segments, force split, aggregation, classification, merging, ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinemill.config import SegmenterConfig
from cinemill.functions import scoring as S
from cinemill.functions import vec
from cinemill.operators.features import SLICE_S, majority_labels
from cinemill.operators.sliced import neighbours, running_sum
from cinemill.session import cut


def _slice() -> Column:
    return F.floor(F.col("second") / SLICE_S)


def segment_seconds(decided: DataFrame) -> DataFrame:
    """Adds ``segment`` (the number of boundaries so far) to decided seconds, without the limit of duration.

    A boundary second starts the new segment; a rise into fast action takes the second before with it.
    """
    rows = neighbours(decided, "video_id", ["second"], _slice(), back=0, ahead=1, carry=["is_boundary", "dominant"])
    rewound = F.coalesce(F.col("next1.is_boundary") & (F.col("next1.dominant") == "motion_spike"), F.lit(False))
    here = F.coalesce(F.col("is_boundary") & (F.col("dominant") != "motion_spike"), F.lit(False))
    rows = rows.withColumn("starts", here | rewound).drop("next1")
    return running_sum(rows, "video_id", ["second"], _slice(), F.col("starts").cast("long"), "segment")


def close_segments(decided: DataFrame, config: SegmenterConfig, unit_ms: float = 1000.0) -> DataFrame:
    """Decided seconds with the segment that each belongs to: ``start_ms``, ``end_ms``, ``reason``, ``confidence``.

    A segment that grows longer than the maximum is split at its largest fused score (the middle one, if that is
    its first second), and the decision of that second is dropped. Boundaries that come so soon after the one
    before that no split can touch them cut a stream into islands; only islands longer than the maximum are
    folded row by row, all others follow from their ends.
    """
    # Only these columns go through the steps; each step is written once, as its result is used twice.
    narrow = cut(decided.select("video_id", "second", "is_boundary", "dominant", "boundary_confidence", "fused"))
    rows = cut(segment_seconds(narrow))
    ends = rows.groupBy("video_id", "segment").agg(F.min("second").alias("first"), F.max("second").alias("last"))
    ends = neighbours(ends, "video_id", ["segment"], F.floor(F.col("segment") / 4096), back=0, ahead=1, carry=["first"])
    # A segment is long if at the second that closes it (or its last one) the open event is over the limit.
    limit = config.maximum_event_s * 1000.0 / unit_ms
    closing = F.coalesce(F.col("next1.first") + 1, F.col("last"))
    ends = cut(ends.withColumn("long", closing - F.col("first") > limit))
    # An island starts with a segment whose predecessor isn't long.
    marks = neighbours(ends.select("video_id", "segment", "first", "last", "long", F.col("next1.first").alias("next_first")), "video_id", ["segment"], F.floor(F.col("segment") / 4096), carry=["long"])
    marks = running_sum(marks.withColumn("opens", (~F.coalesce("prev1.long", F.lit(False))).cast("long")).drop("prev1"), "video_id", ["segment"], F.floor(F.col("segment") / 4096), F.col("opens"), "island")
    marks = cut(marks)
    folded = marks.groupBy("video_id", "island").agg(F.max("long").alias("fold"))
    marks = marks.join(folded, ["video_id", "island"]).select("video_id", "segment", "island", "fold", "next_first")
    rows = cut(rows.join(marks, ["video_id", "segment"]))

    short = rows.filter("not fold")
    closers = narrow.filter("is_boundary").select(
        "video_id",
        F.when(F.col("dominant") == "motion_spike", F.col("second") - 1).otherwise(F.col("second")).alias("next_first"),
        F.col("dominant").alias("reason"),
        F.col("boundary_confidence").alias("confidence"),
    )
    # Two boundaries may claim one start (a spike right after a cut's second): the earlier one has closed the segment by then.
    spike = F.col("reason") == "motion_spike"
    closers = closers.groupBy("video_id", "next_first").agg(F.min_by("reason", spike).alias("reason"), F.min_by("confidence", spike).alias("confidence"))
    spans = short.groupBy("video_id", "segment", "next_first").agg(F.min("second").alias("a"), F.max("second").alias("b"))
    spans = spans.join(closers, ["video_id", "next_first"], "left").select(
        "video_id",
        "segment",
        (F.col("a") * unit_ms).alias("start_ms"),
        (F.coalesce("next_first", "b") * unit_ms).alias("end_ms"),
        F.coalesce("reason", F.lit("stream_end")).alias("reason"),
        F.coalesce("confidence", F.lit(0.5)).alias("confidence"),
    )
    found = ["video_id", "second", "start_ms", "end_ms", "reason", "confidence"]
    plain = short.select("video_id", "second", "segment").join(spans, ["video_id", "segment"]).select(*found)

    schema = T.StructType(
        [T.StructField("video_id", decided.schema["video_id"].dataType), T.StructField("second", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in ("start_ms", "end_ms")]
        + [T.StructField("reason", T.StringType()), T.StructField("confidence", T.DoubleType())]
    )

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("second")
        out = construct(list(group[["second", "is_boundary", "dominant", "boundary_confidence", "fused"]].itertuples(index=False, name=None)), limit)
        closing = group["closing"].iloc[0]
        found = []
        for seconds, start, end, reason, confidence in out:
            if reason is None:  # open at the island's end: closed by the boundary that opens the next island
                if isinstance(closing, dict) or hasattr(closing, "asDict"):
                    closing = dict(closing if isinstance(closing, dict) else closing.asDict())
                    end, reason, confidence = closing["second"], closing["reason"], closing["confidence"]
                else:
                    end, reason, confidence = seconds[-1], "stream_end", 0.5
            found += [(s, start * unit_ms, end * unit_ms, reason, confidence) for s in seconds]
        frame = pd.DataFrame(found, columns=["second", "start_ms", "end_ms", "reason", "confidence"])
        frame.insert(0, "video_id", group["video_id"].iloc[0])
        return frame

    long_rows = rows.filter("fold")
    after = long_rows.groupBy("video_id", "island").agg(F.max_by("next_first", "segment").alias("next_first")).join(closers, ["video_id", "next_first"], "left")
    after = after.select("video_id", "island", F.when(F.col("reason").isNotNull(), F.struct(F.col("next_first").alias("second"), "reason", "confidence")).alias("closing"))
    # Within an island its own first boundary has done its work already.
    first = F.col("second") == F.min("second").over(Window.partitionBy("video_id", "island"))
    spiked = F.col("second") == F.min("second").over(Window.partitionBy("video_id", "island")) + 1
    used = first | (spiked & (F.col("dominant") == "motion_spike"))
    long_rows = long_rows.withColumn("is_boundary", F.col("is_boundary") & ~used).join(after, ["video_id", "island"])
    split = long_rows.groupBy("video_id", "island").applyInPandas(fold, schema)
    return cut(decided.join(plain.unionByName(split), ["video_id", "second"]))


def construct(rows: list[tuple], limit: float) -> list[tuple]:
    """The event constructor over (second, is_boundary, dominant, confidence, fused) rows of one island.

    Gives (seconds, start, end, reason, confidence); the last one, still open, has reason None.
    """
    out, open_, start = [], [], None
    for second, boundary, dominant, confidence, fused in rows:
        start = second if start is None else start
        if second - start > limit:
            open_.append((second, fused))
            at = max(open_, key=lambda x: x[1])[0]
            if at == start and len(open_) > 1:
                at = open_[len(open_) // 2][0]
            out.append(([s for s, _ in open_ if s <= at], start, at, "force_split_max_duration", 0.6))
            open_ = [x for x in open_ if x[0] > at]
            start = open_[0][0] if open_ else None
        elif boundary:
            back = open_.pop() if dominant == "motion_spike" and open_ else None
            end = back[0] if back else second
            if open_:
                out.append(([s for s, _ in open_], start, end, dominant, confidence))
            start, open_ = end, ([back] if back else []) + [(second, fused)]
        else:
            open_.append((second, fused))
    if open_:
        out.append(([s for s, _ in open_], start, None, None, None))
    return out


def pooled(rows: DataFrame, keys: list[str], vector: str, name: str) -> DataFrame:
    """``keys, name``: the mean of the vectors of a group, element by element; where lengths differ, every element's own mean.

    Every batch is summed by group before anything is shuffled: a row of sums and counts for each group in it.
    """
    kinds = [rows.schema[c] for c in keys]
    parts = T.StructType([*kinds, T.StructField("_sums", T.ArrayType(T.DoubleType())), T.StructField("_n", T.ArrayType(T.LongType()))])
    out = T.StructType([*kinds, T.StructField(name, T.ArrayType(T.FloatType()))])

    def added(vectors: list, counts: list | None) -> tuple[np.ndarray, np.ndarray]:
        longest = max(map(len, vectors))
        sums, n = np.zeros(longest), np.zeros(longest, dtype=np.int64)
        for k, v in enumerate(vectors):
            v = np.asarray(v, dtype=np.float64)
            there = ~np.isnan(v)
            sums[: len(v)] += np.where(there, v, 0.0)
            n[: len(v)] += there if counts is None else counts[k]
        return sums, n

    def partly(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [(*(k if isinstance(k, tuple) else (k,)), *added(g[vector].to_list(), None)) for k, g in b.groupby(keys, dropna=False)]
            if made:
                frame = pd.DataFrame(made, columns=parts.names)
                yield frame.astype({c: b[c].dtype for c in keys})

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        sums, n = added(group["_sums"].to_list(), group["_n"].to_list())
        mean = (sums / np.maximum(n, 1)).astype(np.float32)
        return group[keys].iloc[:1].assign(**{name: [mean]})

    there = rows.filter(F.size(vector) > 0).select(*keys, F.transform(vector, lambda x: x.cast("double")).alias(vector))
    return there.mapInPandas(partly, parts).groupBy(*keys).applyInPandas(whole, out)


def events(closed: DataFrame, *, vectors: DataFrame | None = None, embedding: str | None = None) -> DataFrame:
    """One row per segment of ``close_segments``, with its importance, type, people, place and dialogue.

    ``vectors`` has (video_id, second, ``embedding``); their mean is the event's.
    """
    keys = ["video_id", "start_ms"]
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    counts = F.array_sort(F.collect_set("character_count"))
    texts = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.length("dialogue_text") > 0, F.struct("second", "dialogue_text")))), lambda x: F.split(x["dialogue_text"], r" \| ")))
    texts = F.array_distinct(F.filter(F.transform(texts, lambda x: F.trim(x)), lambda x: x != ""))
    out = closed.groupBy(*keys).agg(
        F.first("end_ms").alias("end_ms"),
        F.first("reason").alias("boundary_reason"),
        F.first("confidence").alias("confidence"),
        F.count("*").alias("seconds"),
        S.event_importance(F.max("motion_score"), F.max("novelty_score"), F.avg("audio_energy"), share(F.col("dialogue_present"))).alias("importance"),
        share(F.col("dialogue_present")).alias("_dialogue"),
        share(F.col("action_label") == "fast_action").alias("_action"),
        share(F.col("camera_cue").isin("cut", "fade", "black")).alias("_camera"),
        F.when(F.size(counts) > 0, counts).alias("character_count_range"),
        F.max("character_count").alias("max_characters_seen"),
        F.bool_or("image_available").alias("character_data_available"),
        F.nullif(F.array_join(texts, " "), F.lit("")).alias("dialogue_text"),
    )
    out = out.join(majority_labels(closed, keys, "scene_label", ["second"], "_scene"), keys, "left")
    if embedding:
        own = closed.select("video_id", "second", "start_ms").join(vectors.select("video_id", "second", embedding), ["video_id", "second"])
        out = out.join(pooled(own, keys, embedding, "event_embedding"), keys, "left")
    else:
        out = out.withColumn("event_embedding", F.lit(None).cast("array<float>"))
    out = out.withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
    out = out.withColumn("event_type", S.event_type("seconds", "_dialogue", "_action", "duration_ms", "_camera"))
    return out.withColumn("location_label", F.nullif("_scene", F.lit("unknown"))).drop("_dialogue", "_action", "_camera", "_scene")


def keyframes(seconds: DataFrame, keys: list[str], how: str, value: str) -> DataFrame:
    """``keys, key_frame``: ``value`` of the second with least motion, the middle, most novelty or most motion."""
    if how == "center":
        middle = F.array_sort(F.collect_list(F.struct("second", F.col(value).alias("v"))))
        return seconds.groupBy(*keys).agg(middle.alias("_a")).select(*keys, F.get("_a", F.floor(F.size("_a") / 2).cast("int"))["v"].alias("key_frame"))
    rank = {"lowest_blur": F.col("motion_score"), "highest_novelty": -F.col("novelty_score"), "most_motion": -F.col("motion_score")}
    if how not in rank:
        raise ValueError(f"unknown key frame strategy {how}")
    return seconds.groupBy(*keys).agg(F.min_by(value, F.struct(rank[how], F.col("second"))).alias("key_frame"))


_MERGE = (
    "start_ms double, end_ms double, boundary_reason string, confidence double, importance double, event_type string,"
    " character_count_range array<int>, max_characters_seen int, location_label string, event_embedding array<float>, merged_from int, dialogue_text string, character_data_available boolean"
)


def should_merge(a: str, b: str, threshold: float) -> Column:
    """Whether two consecutive events (structs) are one: no hard boundary, same counts and place, near vectors."""
    f = lambda s, c: F.col(f"{s}.{c}")
    sets = lambda s: F.array_sort(F.coalesce(f(s, "character_count_range"), F.array().cast("array<int>")))
    return (
        ~F.coalesce(f(a, "boundary_reason").isin(*S.HARD_REASONS) | f(b, "boundary_reason").isin(*S.HARD_REASONS), F.lit(False))
        & sets(a).eqNullSafe(sets(b))
        & f(a, "location_label").eqNullSafe(f(b, "location_label"))
        & (vec.cosine_distance(f(a, "event_embedding"), f(b, "event_embedding")) < 1 - threshold)
    )


def merge(found: DataFrame, config: SegmenterConfig, *, keep_details: bool = False) -> DataFrame:
    """Merges consecutive events online, as a fold over the events of a stream (one event is held).

    Two events become one if either is shorter than the minimum or ``should_merge`` holds. As in the reference
    behaviour a merged event loses its dialogue and counts as having data; ``keep_details`` keeps both. The fold
    is a recurrence over a stream's events; they are a small part of its rows and bounded by its length.
    """
    schema = T.StructType([T.StructField("video_id", found.schema["video_id"].dataType), *T._parse_datatype_string(_MERGE).fields])

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        held, out = None, []
        for e in group.sort_values("start_ms").to_dict("records"):
            e["merged_from"] = 1
            if held is None:
                held = e
            elif min(held["end_ms"] - held["start_ms"], e["end_ms"] - e["start_ms"]) < config.minimum_event_s * 1000 or _alike(held, e, config.merge_threshold):
                held = _joined(held, e, keep_details)
            else:
                out.append(held)
                held = e
        return pd.DataFrame([*out, held], columns=schema.names)

    needed = [c for c in schema.names if c not in ("merged_from",)]
    return found.select(*needed).groupBy("video_id").applyInPandas(fold, schema)


def _set(x) -> set:
    return set() if x is None else {int(i) for i in x}


def _null(x):
    return None if x is None or (isinstance(x, float) and x != x) else x


def _alike(a: dict, b: dict, threshold: float) -> bool:
    if a["boundary_reason"] in S.HARD_REASONS or b["boundary_reason"] in S.HARD_REASONS:
        return False
    if _set(a["character_count_range"]) != _set(b["character_count_range"]) or _null(a["location_label"]) != _null(b["location_label"]):
        return False
    x, y = (None if v is None else np.asarray(v, dtype=float) for v in (a["event_embedding"], b["event_embedding"]))
    distance = 0.0
    if x is not None and y is not None and x.shape == y.shape and x.size:
        size = float(np.linalg.norm(x)), float(np.linalg.norm(y))
        if min(size) >= 1e-10:
            distance = min(max((1 - float(x @ y) / (size[0] * size[1])) / 2, 0.0), 1.0)
    return distance < 1 - threshold


def _joined(a: dict, b: dict, keep_details: bool) -> dict:
    da, db = a["end_ms"] - a["start_ms"], b["end_ms"] - b["start_ms"]
    weighted = (a["importance"] * da + b["importance"] * db) / (da + db) if da + db > 0 else (a["importance"] + b["importance"]) / 2
    counts = sorted(_set(a["character_count_range"]) | _set(b["character_count_range"]))
    most = [int(x) for x in (_null(a["max_characters_seen"]), _null(b["max_characters_seen"])) if x is not None]
    x, y = a["event_embedding"], b["event_embedding"]
    if x is not None and y is not None and len(x) == len(y):
        x = ((np.asarray(x, dtype=float) + np.asarray(y, dtype=float)) / 2).astype("float32")
    texts = [t for t in (_null(a["dialogue_text"]), _null(b["dialogue_text"])) if t]
    return a | {
        "end_ms": b["end_ms"],
        "boundary_reason": b["boundary_reason"],
        "confidence": min(a["confidence"], b["confidence"]),
        "importance": weighted,
        "character_count_range": counts or None,
        "max_characters_seen": max(most) if most else None,
        "event_embedding": x,
        "merged_from": a["merged_from"] + b["merged_from"],
        "dialogue_text": " ".join(texts) or None if keep_details else None,
        "character_data_available": bool(a["character_data_available"] or b["character_data_available"]) if keep_details else True,
    }


def numbered(found: DataFrame) -> DataFrame:
    """Contiguous ``event_id`` per stream in order of time, and the ``summary`` template."""
    rows = running_sum(found, "video_id", ["start_ms"], F.floor(F.col("start_ms") / (SLICE_S * 1000)), F.lit(1), "event_id")
    rows = rows.withColumn("event_id", (F.col("event_id") - 1).cast("int"))
    return rows.withColumn("summary", S.template_summary("event_type", "location_label", "max_characters_seen"))


def chain(found: DataFrame) -> DataFrame:
    """The edges (video_id, src, dst) from every event to the next."""
    rows = neighbours(found.select("video_id", "event_id"), "video_id", ["event_id"], F.floor(F.col("event_id") / 4096), back=0, ahead=1)
    return rows.select("video_id", F.col("event_id").alias("src"), F.col("next1.event_id").alias("dst")).filter("dst is not null")


def split_events(found: DataFrame, seconds: DataFrame, maximum_s: float) -> DataFrame:
    """Splits events over the maximum at their largest fused score: two rows (part 1 and 2) that meet there.

    ``seconds`` has (video_id, event_id, timestamp_ms, fused, novelty_score). If the peak is the first second the
    next best one counts; an event that would leave one side empty stays as it is (part 0). Importance is the
    mean novelty of each side.
    """
    keys = ["video_id", "event_id"]
    own = seconds.join(found.select(*keys, "start_time_ms", "end_time_ms"), keys)
    inner = F.when(F.col("timestamp_ms") != F.col("start_time_ms"), F.struct("fused", -F.col("timestamp_ms")))
    peaks = own.groupBy(*keys).agg(
        F.max_by("timestamp_ms", F.struct("fused", -F.col("timestamp_ms"))).alias("top"), F.max_by("timestamp_ms", inner).alias("second_top"), F.count("*").alias("n")
    )
    rows = found.join(peaks, keys, "left")
    at = F.when((F.col("top") == F.col("start_time_ms")) & (F.col("n") > 2), F.col("second_top")).otherwise(F.col("top"))
    long = F.col("end_time_ms") - F.col("start_time_ms") > maximum_s * 1000
    rows = rows.withColumn("at", F.when(long & (at != F.col("start_time_ms")) & (at != F.col("end_time_ms")), at))
    sides = own.join(rows.select(*keys, "at"), keys).groupBy(*keys).agg(
        F.avg(F.when(F.col("timestamp_ms") <= F.col("at"), F.col("novelty_score"))).alias("n1"),
        F.avg(F.when(F.col("timestamp_ms") > F.col("at"), F.col("novelty_score"))).alias("n2"),
        F.count_if(F.col("timestamp_ms") > F.col("at")).alias("after"),
    )
    rows = rows.join(sides, keys, "left").withColumn("at", F.when(F.col("after") > 0, F.col("at")))
    one = F.struct(F.lit(1).alias("part"), F.col("start_time_ms").alias("a"), F.col("at").alias("b"), F.col("n1").alias("i"), F.lit("force_split_max_duration").alias("r"))
    two = F.struct(F.lit(2).alias("part"), F.col("at").alias("a"), F.col("end_time_ms").alias("b"), F.col("n2").alias("i"), F.lit("force_split_continuation").alias("r"))
    same = F.struct(F.lit(0).alias("part"), F.col("start_time_ms").alias("a"), F.col("end_time_ms").alias("b"), F.col("importance").alias("i"), F.col("boundary_reason").alias("r"))
    parts = rows.select(*keys, F.explode(F.when(F.col("at").isNotNull(), F.array(one, two)).otherwise(F.array(same))).alias("p"))
    return parts.select(*keys, "p.part", F.col("p.a").alias("start_time_ms"), F.col("p.b").alias("end_time_ms"), F.col("p.i").alias("importance"), F.col("p.r").alias("boundary_reason"))
