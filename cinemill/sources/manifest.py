"""JSON lines in and out: manifests of kept packets, events, the readable log, metrics."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinemill.functions import text as X
from cinemill.operators.sliced import neighbours

#: Field, type and the value of a missing key.
MANIFEST = {
    "video_id": ("long", 0), "frame_id": ("long", 0), "timestamp_ms": ("double", 0.0), "fps_used": ("double", 1.0), "motion_score": ("double", 0.0),
    "scene_change": ("boolean", False), "audio_energy": ("double", 0.0), "novelty_score": ("double", 0.0), "decision_reason": ("string", ""), "subtitle_text": ("string", None),
}
EVENT_FIELDS = (
    "event_id start_time_ms end_time_ms duration_ms importance confidence summary boundary_reason event_type"
    " character_count_range max_characters_seen character_data_available location_label character_labels"
).split()
#: So many event ids of a stream are in one slice of its graph.
GRAPH_SLICE = 4096


def manifest_rows(packets: DataFrame) -> DataFrame:
    """The fields of a manifest; times to 3 places, scores to 4."""
    places = {"timestamp_ms": 3, "motion_score": 4, "audio_energy": 4, "novelty_score": 4}
    return packets.select(*[F.round(c, places[c]).alias(c) if c in places else F.col(c) for c in MANIFEST])


def write_manifest(packets: DataFrame, path: str) -> None:
    manifest_rows(packets).write.mode("overwrite").json(path)


def manifest_defaults(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.coalesce(F.col(c), F.lit(d)).alias(c) if d is not None else F.col(c) for c, (_, d) in MANIFEST.items()])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest with defaults for missing keys; blank lines are skipped."""
    schema = ", ".join(f"{c} {t}" for c, (t, _) in MANIFEST.items())
    return manifest_defaults(spark.read.schema(schema).json(path))


def event_rows(events: DataFrame, *, embedding: bool = False) -> DataFrame:
    """The fields of an events file: times to 1 place, scores to 4, on request the first 32 dimensions to 6."""
    places = {"start_time_ms": 1, "end_time_ms": 1, "duration_ms": 1, "importance": 4, "confidence": 4}
    out = [F.round(c, places[c]).alias(c) if c in places else F.col(c) for c in EVENT_FIELDS]
    if embedding:
        # Both are NULL, so absent from the file, for an event without a vector.
        head = F.transform(F.slice("event_embedding", 1, 32), lambda x: F.round(x.cast("double"), 6))
        out += [head.alias("event_embedding"), F.when(F.col("event_embedding").isNotNull(), F.size("event_embedding")).alias("event_embedding_dim")]
    return events.select("video_id", *out)


def write_events(events: DataFrame, path: str, *, embedding: bool = False) -> None:
    """Written over: also the second writing after names are resolved."""
    event_rows(events, embedding=embedding).write.mode("overwrite").partitionBy("video_id").json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def event_log(events: DataFrame) -> DataFrame:
    """``video_id, log``: the readable log of every stream, a block per event in order, blank lines between."""
    people = X.people_shown("character_labels", "max_characters_seen")
    block = X.event_block(F.col("event_id") + 1, "start_time_ms", "end_time_ms", "event_type", people, "location_label", "summary")
    return events.groupBy("video_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("log")
    )


def event_graph(events: DataFrame, *, sliced: bool = False) -> DataFrame:
    """``video_id, graph``: a stream's events with the events that each comes before, and those edges, as JSON.

    Of an event come its id, times, type and summary, ``before`` (the id of the next one) and ``causes`` (always empty);
    ``edges_before`` has the pairs of ids. A NULL field is written as null.

    ``sliced``: a row for every ``GRAPH_SLICE`` ids of a stream, numbered in ``slice``, with the events and the edges that
    begin there; a stream's rows in that order are its whole graph, however long, and none of them grows with it.
    """
    slice_ = F.floor(F.col("event_id") / GRAPH_SLICE)
    rows = neighbours(events, "video_id", ["event_id"], slice_, back=0, ahead=1, carry=["event_id"])
    following = F.when(F.col("next1").isNotNull(), F.array("next1.event_id")).otherwise(F.array().cast("array<bigint>"))
    fields = [F.col(c) for c in ("event_id", "start_time_ms", "end_time_ms", "event_type", "summary")]
    node = F.to_json(F.struct(*fields, following.alias("before"), F.array().cast("array<string>").alias("causes")), {"ignoreNullFields": "false"})
    edge = F.when(F.col("next1").isNotNull(), F.to_json(F.array("event_id", "next1.event_id")))
    keys = ["video_id", "slice"] if sliced else ["video_id"]
    parts = rows.select("video_id", slice_.alias("slice"), "event_id", node.alias("node"), edge.alias("edge")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("event_id", "node", "edge"))).alias("a"))
    joined = lambda c: F.array_join(F.array_compact(F.transform("a", lambda x: x[c])), ",")
    return parts.select(*keys, F.concat(F.lit('{"events":['), joined("node"), F.lit('],"edges_before":['), joined("edge"), F.lit("]}")).alias("graph"))


def comparison_table(rows: list[dict], columns: list[str]) -> str:
    """A Markdown table of a few driver-side measurements."""
    cell = lambda x: f"{x:.4g}" if isinstance(x, float) else str(x)
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join([*lines, *["| " + " | ".join(cell(r.get(c, "")) for c in columns) + " |" for r in rows]])


def write_metrics(metrics: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(metrics, f, indent=2, sort_keys=True)
