"""The sampler: signals of frames, importance, target rate, and which frames are kept."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinemill.config import SamplerConfig
from cinemill.functions import scoring as S
from cinemill.operators.sliced import neighbours, running_max, running_sum
from cinemill.session import cut

SLICE_MS = 3_600_000


def clean_packets(df: DataFrame, *, keep_image: bool = False) -> DataFrame:
    """One row per (video_id, frame_id), the first to arrive, with scores as numbers in [0, 1].

    Images are left out but for whether there is one, unless ``keep_image``. Rows without a time or key are left out. The copies of a packet are reduced before the shuffle.
    """
    t = F.col("timestamp_ms")
    good = df.filter(t.isNotNull() & ~F.isnan(t) & F.col("video_id").isNotNull() & F.col("frame_id").isNotNull())
    fields = ["arrived_at", *[c for c in df.columns if c not in ("video_id", "frame_id", "arrived_at", "image")]]
    has_image = F.col("image").isNotNull().alias("has_image") if "image" in df.columns else F.lit(False).alias("has_image")
    if keep_image:
        fields.append("image")
    out = good.groupBy("video_id", "frame_id").agg(F.min(F.struct(*fields, has_image)).alias("p")).select("video_id", "frame_id", "p.*")
    return out.withColumns({c: S.unit_score(c) for c in ("motion_score", "audio_energy", "novelty_score")})


def estimated_times(df: DataFrame, key: str, order: list[str], pts: str, fps: Column, *, slice_: Column | None = None) -> DataFrame:
    """``df`` with ``timestamp_ms``: ``pts`` where known, else one frame after the frame before (40 ms if fps <= 0).

    A run of missing times counts on from the last known one, so the estimate needs no recurrence: it is a
    running sum less that sum at the last known time. ``slice_`` cuts a stream along ``order`` for the sums.
    """
    slice_ = F.lit(0) if slice_ is None else slice_
    step = F.when(fps > 0, 1000.0 / fps).otherwise(40.0)
    rows = running_sum(df.withColumn("_step", step), key, order, slice_, F.col(pts).isNotNull().cast("long"), "_run")
    rows = running_sum(rows, key, order, slice_, F.when(F.col(pts).isNull(), F.col("_step")).otherwise(0.0), "_sum")
    rows = cut(rows)
    known = rows.filter(F.col(pts).isNotNull()).select(F.col(key).alias("_k"), F.col("_run").alias("_r"), (F.col(pts) - F.col("_sum")).alias("_from"))
    out = rows.join(known, (F.col(key) == F.col("_k")) & (F.col("_run") == F.col("_r")), "left")
    return out.withColumn("timestamp_ms", F.coalesce(F.col(pts), F.coalesce("_from", F.lit(0.0)) + F.col("_sum"))).drop("_run", "_step", "_sum", "_k", "_r", "_from")


def strictly_rising(df: DataFrame, key: str, arrival: list[str], time: str, *, slice_: Column | None = None) -> DataFrame:
    """Rows whose time is larger than that of every row that arrived before in ``key``; ``slice_`` cuts a stream along ``arrival``."""
    rows = running_max(df, key, arrival, F.lit(0) if slice_ is None else slice_, F.col(time), "_most")
    return rows.filter(F.col("_most").isNull() | (F.col(time) > F.col("_most"))).drop("_most")


def recent(df: DataFrame, key: str, order: list[str], slice_: Column, value: str, rows: int) -> DataFrame:
    """``df`` with ``recent``: the last ``rows`` values that aren't NULL, among as many rows and the current one, oldest first."""
    found = neighbours(df, key, order, slice_, back=rows - 1, carry=[value])
    values = [F.col(f"prev{i}.{value}") for i in range(rows - 1, 0, -1)] + [F.col(value)]
    return found.withColumn("recent", F.array_compact(F.array(*values))).drop(*[f"prev{i}" for i in range(1, rows)])


# ---- audio and subtitles ----------------------------------------------------------------------


def audio_windows(samples: DataFrame, key: str, position: str, value: str, *, window: int, window_ms: float = 250.0) -> DataFrame:
    """Loudness per fixed window of ``window`` samples: (key, idx, start_ms, end_ms, energy, silence).

    Energy is the window's RMS through five times the stream's, at most 1; an incomplete last window is left
    out. The stream's RMS is an aggregate joined back, so no stream becomes one task.
    """
    x = F.col(value).cast("double")
    rows = samples.filter(x.isNotNull() & ~F.isnan(x)).select(F.col(key), F.floor(F.col(position) / window).cast("long").alias("idx"), (x * x).alias("s"))
    parts = rows.groupBy(key, "idx").agg(F.sum("s").alias("s"), F.count("*").alias("n"))
    whole = parts.groupBy(key).agg((F.sqrt(F.sum("s") / F.sum("n")) * 5.0 + 1e-9).alias("most"))
    rms = F.sqrt(F.col("s") / F.col("n"))
    return parts.filter(F.col("n") == window).join(whole, key).select(
        key,
        "idx",
        (F.col("idx") * window_ms).alias("start_ms"),
        ((F.col("idx") + 1) * window_ms).alias("end_ms"),
        S.clip(rms / F.col("most")).alias("energy"),
        (rms < 0.02).alias("silence"),
    )


def with_audio(frames: DataFrame, windows: DataFrame, key: str, time: str, *, window_ms: float = 250.0) -> DataFrame:
    """Frames with the energy and silence of the audio window at their time.

    Windows have a fixed width and no gaps, so the interval lookup is an equi-join on the window's number; a time
    beyond the end meets the last window, one before the start or a stream without sound counts as silent.
    """
    last = windows.groupBy(key).agg(F.max("idx").alias("_last"))
    idx = F.when(F.col(time) >= 0, F.least(F.floor(F.col(time) / window_ms), F.col("_last")))
    rows = frames.join(last, key, "left").withColumn("idx", idx).drop("_last")
    out = rows.join(windows.select(key, "idx", "energy", "silence"), [key, "idx"], "left").drop("idx")
    return out.withColumns({"energy": F.coalesce("energy", F.lit(0.0)), "silence": F.coalesce("silence", F.lit(True))})


def subtitle_at(frames: DataFrame, cues: DataFrame, key: str, time: str, *, id_: list[str], slot_ms: float = 10_000.0) -> DataFrame:
    """``key, id_, subtitle``: the text of the first cue (by cue_idx) with start <= time < end; NULL if none.

    Cues stand in every slot that they touch, so the range join is an equi-join on (key, slot).
    """
    slots = cues.filter("end_ms > start_ms").withColumn("slot", F.explode(F.sequence(F.floor(F.col("start_ms") / slot_ms), F.floor(F.col("end_ms") / slot_ms))))
    left = frames.select(key, *id_, F.col(time).alias("_t")).withColumn("slot", F.floor(F.col("_t") / slot_ms))
    met = left.join(slots.select(key, "slot", "cue_idx", "start_ms", "end_ms", "text"), [key, "slot"], "left")
    inside = (F.col("start_ms") <= F.col("_t")) & (F.col("_t") < F.col("end_ms"))
    return met.groupBy(key, *id_).agg(F.min(F.when(inside, F.struct("cue_idx", "text"))).alias("c")).select(key, *id_, F.col("c.text").alias("subtitle"))


def subtitle_density(frames: DataFrame, cues: DataFrame, key: str, time: str, *, id_: list[str], window_ms: float = 5000.0, slot_ms: float = 10_000.0) -> DataFrame:
    """``key, id_, density``: the share of [time, time + window) under cues, at most 1; overlapping cues count twice."""
    slots = cues.filter("end_ms > start_ms").withColumn("slot", F.explode(F.sequence(F.floor((F.col("start_ms") - window_ms) / slot_ms), F.floor(F.col("end_ms") / slot_ms))))
    left = frames.select(key, *id_, F.col(time).alias("_t")).withColumn("slot", F.floor(F.col("_t") / slot_ms))
    met = left.join(slots.select(key, "slot", "start_ms", "end_ms"), [key, "slot"], "left")
    overlap = F.least(F.col("end_ms"), F.col("_t") + window_ms) - F.greatest(F.col("start_ms"), F.col("_t"))
    covered = F.sum(F.when(F.col("start_ms").isNotNull(), F.greatest(overlap, F.lit(0.0))))
    return met.groupBy(key, *id_).agg(S.clip(F.coalesce(covered, F.lit(0.0)) / window_ms).alias("density"))


def clean_cues(cues: DataFrame) -> DataFrame:
    """One row per (video_id, cue_idx) with usable times; texts without markup and outer space, blank ones NULL."""
    text = F.trim(F.regexp_replace(F.regexp_replace("text", r"<[^>]*>|\{[^}]*\}|♪", ""), r"\s+", " "))
    good = cues.filter("video_id is not null and cue_idx is not null and start_ms is not null and end_ms is not null and end_ms > start_ms")
    return good.select("video_id", "cue_idx", "start_ms", "end_ms", F.nullif(text, F.lit("")).alias("text")).groupBy("video_id", "cue_idx").agg(
        F.min(F.struct("start_ms", "end_ms", "text")).alias("c")
    ).select("video_id", "cue_idx", "c.*")


# ---- decision ---------------------------------------------------------------------------------


def decide(df: DataFrame, config: SamplerConfig, density: str = "density") -> DataFrame:
    """Adds ``importance``, ``target_fps`` and ``reason`` to rows with the five signals."""
    terms = S.weighted_terms(config.weights, "motion_score", "scene_change", "audio_energy", density, "novelty_score")
    rows = df.withColumn("importance", S.importance(terms))
    fps = S.clamp_fps(S.importance_to_fps("importance"), config.minimum_fps, config.maximum_fps)
    return rows.withColumns({"target_fps": fps, "reason": S.decision_reason(terms, "importance")})


def schedule(df: DataFrame, key: str, time: str, fps: str, *, order: list[str], slice_ms: float = SLICE_MS) -> DataFrame:
    """The rows that an adaptive-rate scheduler keeps: the first of a stream, and every row that comes at least
    ``1000 / fps`` ms (its own rate, at least 0.01) after the last row kept.

    A recurrence, but a short one: whatever was kept before, two runs through the same rows soon keep the same ones.
    So every slice of a stream is first run as if its first row were kept; then, in rounds, slices whose predecessor
    ends with another row than assumed are run again, until all agree (at worst a round per slice, as a rule two or
    three). Rows must be in strictly rising time (see ``strictly_rising``); such with NULL time or rate are left out.
    """
    gap = 1000.0 / F.greatest(F.col(fps), F.lit(0.01))
    rows = df.filter(F.col(time).isNotNull() & F.col(fps).isNotNull()).withColumns({"_at": F.col(time).cast("double"), "_gap": gap, "_slice": F.floor(F.col(time) / slice_ms)})
    rows = cut(rows)
    kind, names = df.schema[key].dataType, df.columns
    ends = T.StructType([T.StructField("_k", kind), T.StructField("_s", T.LongType()), T.StructField("_in", T.DoubleType()), T.StructField("_out", T.DoubleType())])

    def run(group: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        group = group.sort_values(["_at", *order], ignore_index=True)
        began = group["_in"].iloc[0]
        return group, kept_rows(group["_at"].to_numpy(), group["_gap"].to_numpy(), None if pd.isna(began) else float(began))

    def last_kept(group: pd.DataFrame) -> pd.DataFrame:
        group, kept = run(group)
        began = group["_in"].iloc[0]
        out = group["_at"].iloc[kept[-1]] if len(kept) else began
        return pd.DataFrame({"_k": [group["_key"].iloc[0]], "_s": [int(group["_slice"].iloc[0])], "_in": [began], "_out": [out]})

    lean = rows.select(F.col(key).alias("_key"), "_slice", "_at", "_gap", *order)
    known = cut(lean.withColumn("_in", F.lit(None).cast("double")).groupBy("_key", "_slice").applyInPandas(last_kept, ends))
    before = F.lag("_out").over(Window.partitionBy("_k").orderBy("_s"))
    while True:
        told = cut(known.withColumn("_new", before))
        wrong = told.filter(~F.col("_new").eqNullSafe(F.col("_in"))).select(F.col("_k").alias("_wk"), F.col("_s").alias("_ws"), "_new")
        if not wrong.limit(1).count():
            break
        again = lean.join(wrong, F.col("_key").eqNullSafe(F.col("_wk")) & (F.col("_slice") == F.col("_ws"))).drop("_wk", "_ws").withColumnRenamed("_new", "_in")
        right = told.filter(F.col("_new").eqNullSafe(F.col("_in"))).drop("_new")
        known = cut(right.unionByName(again.groupBy("_key", "_slice").applyInPandas(last_kept, ends)))
    whole = rows.join(known.select("_k", "_s", "_in"), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_slice") == F.col("_s"))).drop("_k", "_s")

    def keep(group: pd.DataFrame) -> pd.DataFrame:
        group, kept = run(group)
        return group.iloc[kept][names]

    return whole.groupBy(key, "_slice").applyInPandas(keep, df.schema)


def kept_rows(at: np.ndarray, gap: np.ndarray, last: float | None) -> np.ndarray:
    """The places of the rows kept after ``last`` (None: the first row is kept), for rising times and each row's own gap."""
    if not len(at):
        return np.empty(0, dtype=np.int64)
    # Row j may follow row i if at[j] - at[i] >= gap[j]; the next kept row after i is the first such j.
    following = np.full(len(at), len(at))
    open_ = np.arange(len(at) - 1)
    step = 1
    while len(open_):
        fits = at[open_ + step] - at[open_] >= gap[open_ + step]
        following[open_[fits]] = open_[fits] + step
        step += 1
        open_ = open_[~fits]
        open_ = open_[open_ + step < len(at)]
    if last is None:
        i = 0
    else:
        fits = np.flatnonzero(at - last >= gap)
        i = int(fits[0]) if len(fits) else len(at)
    kept, following = [], following.tolist()
    while i < len(at):
        kept.append(i)
        i = following[i]
    return np.array(kept, dtype=np.int64)


def transitions(df: DataFrame, key: str, order: list[str], score: str, black: str, threshold: float = 0.45, slice_: Column | None = None) -> DataFrame:
    """Adds ``scene_changed``: false in a stream's first row, true if black, else whether ``score`` exceeds the threshold."""
    rows = neighbours(df, key, order, slice_ if slice_ is not None else F.lit(0), carry=order)
    changed = F.when(F.col("prev1").isNull(), False).when(F.col(black), True).otherwise(F.coalesce(F.col(score) > threshold, F.lit(False)))
    return rows.withColumn("scene_changed", changed).drop("prev1")


def rolling_mean(df: DataFrame, key: str, order: list[str], vector: str, name: str, *, rows: int, include_current: bool, slice_: Column | None = None, block: int = 4096) -> DataFrame:
    """``df`` with the element-wise mean of ``vector`` over the last ``rows`` rows, with or without the current one.

    A stream's rows are numbered (over slices of it along ``order``) and cut into blocks; every block also gets the
    ``rows`` rows before it, and has its means from running sums. NULL without any row before. All vectors that
    aren't NULL must have one length; NULL ones don't count but for their place.
    """
    numbered = running_sum(df, key, order, F.lit(0) if slice_ is None else slice_, F.lit(1), "_i")
    block = max(block, rows)
    at = F.floor((F.col("_i") - 1) / block)
    tail = (F.col("_i") - 1) % block >= block - rows
    spread = numbered.withColumn("_b", F.explode(F.when(tail, F.array(at, at + 1)).otherwise(F.array(at)))).withColumn("_own", F.col("_b") == at)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def means(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_i", ignore_index=True)
        there = group[vector].notna().to_numpy()
        out = np.full(len(group), None, dtype=object)
        if there.any():
            x = np.zeros((len(group), len(group[vector][there.argmax()])))
            x[there] = np.stack(group[vector][there].to_list())
            sums = np.vstack([np.zeros(x.shape[1]), x.cumsum(axis=0)])
            count = np.r_[0, there.cumsum()]
            stop = np.arange(len(group)) + (1 if include_current else 0)
            start = np.maximum(stop - rows, 0)
            n = count[stop] - count[start]
            mean = (sums[stop] - sums[start]) / np.maximum(n, 1)[:, None]
            for k in np.flatnonzero((n > 0) & group["_own"].to_numpy()):
                out[k] = mean[k]
        return group.assign(**{name: out})[group["_own"]][schema.names]

    return spread.groupBy(key, "_b").applyInPandas(means, schema)
