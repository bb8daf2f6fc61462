"""Faces and names: online clusters, reference matching, votes for names, relabelling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinemill.functions import text as X
from cinemill.functions import vec


def person_label(k: int) -> str:
    """Person A to Person Z, then Person 27 and so on."""
    return f"Person {chr(65 + k)}" if k < 26 else f"Person {k + 1}"


class OnlineClusters:
    """Nearest centroid by Euclidean distance; below ``limit`` the centroid moves by ``rate``, else a new one."""

    def __init__(self, limit: float = 0.6, rate: float = 0.1):
        self.limit, self.rate = limit, rate
        self.centroids: list[np.ndarray] = []

    def assign(self, x: np.ndarray) -> str:
        if self.centroids:
            distances = np.linalg.norm(np.asarray(self.centroids) - x, axis=1)
            k = int(distances.argmin())
            if distances[k] < self.limit:
                self.centroids[k] = (1 - self.rate) * self.centroids[k] + self.rate * x
                return person_label(k)
        self.centroids.append(np.asarray(x, dtype=np.float64))
        return person_label(len(self.centroids) - 1)


def online_clusters(faces: DataFrame, key: str, order: list[str], vector: str, *, limit: float = 0.6, rate: float = 0.1) -> DataFrame:
    """``key, order, label``: labels given one after another in a stream's order.

    By definition a recurrence over a stream: every label depends on all faces before. Rows come sorted and
    in batches, and a stream's state is its centroids, so no stream is ever held in memory.
    """
    schema = T.StructType([faces.schema[key], *[faces.schema[c] for c in order], T.StructField("label", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, clusters = object(), None
        for b in batches:
            labels = []
            for k, v in zip(b[key], b[vector]):
                if k != current:
                    current, clusters = k, OnlineClusters(limit, rate)
                labels.append(clusters.assign(np.asarray(v, dtype=np.float64)))
            yield b[[key, *order]].assign(label=labels)

    good = faces.filter((F.size(vector) > 0) & F.exists(vector, lambda x: x != 0))
    return good.repartition(key).sortWithinPartitions(key, *order).select(key, *order, vector).mapInPandas(run, schema)


def nearest_reference(faces: DataFrame, keys: list[str], vector: str, gallery: DataFrame, name: str, reference: str, *, limit: float = 0.5) -> DataFrame:
    """``keys, name, distance``: the reference nearest to every face, its name NULL unless closer than ``limit``.

    The gallery is a handful of photos named on the command line, so every face meets every one of them; of equal
    distances the first name counts.
    """
    met = faces.select(*keys, F.col(vector).alias("_v")).join(F.broadcast(gallery.select(F.col(name).alias("_n"), F.col(reference).alias("_r"))), F.size("_v") == F.size("_r"))
    best = met.groupBy(*keys).agg(F.min(F.struct(vec.euclidean("_v", "_r").alias("d"), F.col("_n").alias("n"))).alias("b"))
    return best.select(*keys, F.when(F.col("b.d") < limit, F.col("b.n")).alias("name"), F.col("b.d").alias("distance"))


def name_votes(events: DataFrame) -> DataFrame:
    """``video_id, label, name, votes`` of events with exactly one label whose dialogue calls a name out."""
    heard = events.filter(F.size("character_labels") == 1).select("video_id", F.get("character_labels", F.lit(0)).alias("label"), X.vocative("dialogue_text").alias("m"))
    return heard.filter("m.confidence = 'high'").groupBy("video_id", "label", F.col("m.name").alias("name")).agg(F.count("*").alias("votes"))


def resolved_names(votes: DataFrame, least: int = 1) -> DataFrame:
    """``video_id, label, name``: labels whose top name has at least ``least`` votes and more than all others together."""
    best = votes.groupBy("video_id", "label").agg(F.max_by("name", F.struct("votes", "name")).alias("name"), F.max("votes").alias("top"), F.sum("votes").alias("total"))
    return best.filter((F.col("top") >= least) & (F.col("top") * 2 > F.col("total"))).select("video_id", "label", "name")


def relabel(events: DataFrame, names: DataFrame) -> DataFrame:
    """``events`` with resolved names in ``character_labels`` and ``summary``."""
    maps = names.groupBy("video_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "name")))).alias("_m"))
    rows = events.join(maps, "video_id", "left")
    labels = F.transform("character_labels", lambda x: F.coalesce(F.try_element_at(F.col("_m"), x), x))
    there = F.col("_m").isNotNull()
    return rows.withColumns(
        {"character_labels": F.when(there, labels).otherwise(F.col("character_labels")), "summary": F.when(there, X.relabelled("summary", "_m")).otherwise(F.col("summary"))}
    ).drop("_m")


def overlap(a, b) -> Column:
    """Intersection through union of two boxes (structs x, y, w, h)."""
    side = lambda p, l: F.greatest(F.least(a[p] + a[l], b[p] + b[l]) - F.greatest(a[p], b[p]), F.lit(0.0))
    both = side("x", "w") * side("y", "h")
    union = a["w"] * a["h"] + b["w"] * b["h"] - both
    return F.when(union > 0, both / union).otherwise(0.0)


def distinct_boxes(boxes, most: float = 0.3) -> Column:
    """The boxes of an array, in order, that overlap no box kept before by more than ``most``."""
    c = boxes if isinstance(boxes, Column) else F.col(boxes)
    none = F.slice(c, 1, 0)
    return F.aggregate(c, none, lambda kept, x: F.when(F.exists(kept, lambda k: overlap(k, x) > most), kept).otherwise(F.array_append(kept, x)))
