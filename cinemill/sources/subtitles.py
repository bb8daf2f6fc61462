"""Subtitle files as cue tables: SRT and WebVTT."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinemill.functions import text as X

CUES = "video_id string, cue_idx int, start_ms double, end_ms double, text string"
KINDS = {".srt": "srt", ".vtt": "vtt", ".webvtt": "vtt"}


def parse_cues(files: DataFrame, name: str, content: str) -> DataFrame:
    """Cues of whole files (one row each), numbered in file order; works for both formats.

    A cue is a block with a line ``start --> end``; all lines after it are its text. Blocks without such a line
    (headers, notes, styles) are passed over; times that can't be read count as 0.
    """
    body = F.regexp_replace(F.regexp_replace(F.col(content), "\r\n?", "\n"), "^﻿", "")
    blocks = files.select(F.col(name).alias("video_id"), F.posexplode(F.split(body, r"\n[ \t]*\n+")).alias("_b", "block"))
    pattern = r"(?s)(?:^|\n)[ \t]*([0-9:.,]+)[ \t]+-->[ \t]+([0-9:.,]+)[^\n]*(?:\n(.*))?$"
    part = lambda i: F.regexp_extract("block", pattern, i)
    cues = blocks.filter(F.col("block").rlike(pattern)).select(
        "video_id", "_b", X.parse_time(part(1)).alias("start_ms"), X.parse_time(part(2)).alias("end_ms"), F.regexp_replace(part(3), r"\s+$", "").alias("text")
    )
    # The place of the block among the cues of its file, without a window over the files.
    cues = cues.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("_b", "start_ms", "end_ms", "text"))).alias("a"))
    return cues.select("video_id", F.posexplode("a").alias("cue_idx", "c")).select("video_id", "cue_idx", "c.start_ms", "c.end_ms", "c.text")


def read_subtitles(spark: SparkSession, path: str | None) -> DataFrame:
    """Cues of a file or folder; an empty table for None, a missing path or an unknown extension."""
    empty = spark.createDataFrame([], CUES)
    if not path or "://" not in path and not os.path.exists(path):
        return empty
    if os.path.isfile(path) and os.path.splitext(path)[1].lower() not in KINDS:
        return empty
    files = spark.read.text(path, wholetext=True).withColumn("video_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1))
    return parse_cues(files, "video_id", "value")


def srt_block(cue_idx, start_ms, end_ms, text) -> Column:
    """One cue in SRT form."""
    return F.concat((F.col(cue_idx) + 1).cast("string"), F.lit("\n"), X.srt_time(start_ms), F.lit(" --> "), X.srt_time(end_ms), F.lit("\n"), F.col(text))
