"""Boundary signals of consecutive seconds, their fusion, and the decision of every second."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinemill.config import SegmenterConfig
from cinemill.functions import scoring as S
from cinemill.functions import vec
from cinemill.operators.features import SLICE_S
from cinemill.operators.sliced import neighbours, running_max

_NEEDED = ["second", "scene_label", "character_count", "dialogue_present", "music_mood", "action_label"]


def signals(seconds: DataFrame, *, embedding: str | None = None, exclude_current: bool = False) -> DataFrame:
    """The eight signals of every second against the one before; a stream's first second has none (NULLs).

    The ``embedding`` itself is left out of the result; join it again by (video_id, second) where it is pooled.

    The prediction compares the current vector with an extrapolation of a history that, as in the reference
    behaviour, already ends with the current second; ``exclude_current`` extrapolates from the two before.
    """
    carry = [*_NEEDED, *([embedding] if embedding else [])]
    back = 3 if exclude_current else 2
    rows = neighbours(seconds, "video_id", ["second"], F.floor(F.col("second") / SLICE_S), back=back, carry=carry)
    there = F.col("prev1").isNotNull()
    moved = S.clip(F.abs(F.col("character_count") - F.col("prev1.character_count")) / 2)
    out = {
        "scene": S.changed("scene_label", "prev1.scene_label"),
        "character": F.coalesce(moved, F.lit(0.0)),
        "dialogue": S.changed("dialogue_present", "prev1.dialogue_present"),
        "camera": F.coalesce(F.col("camera_cue").isin("cut", "fade"), F.lit(False)).cast("double"),
        "emotion": F.lit(0.0),
        "music": S.changed("music_mood", "prev1.music_mood"),
        "embedding": F.lit(0.0),
        "prediction_error": F.lit(0.0),
    }
    if embedding:
        now, one, two = F.col(embedding), F.col(f"prev1.{embedding}"), F.col(f"prev2.{embedding}")
        # The vectors go no further than this step: what follows needs their two distances.
        rows = rows.withColumn("_step", vec.step_distances(now, one, two) if exclude_current else vec.step_distances(now, one))
        out["embedding"], out["prediction_error"] = F.col("_step.moved"), F.col("_step.surprise")
    rows = rows.withColumns({f"{k}_signal": F.when(there, v) for k, v in out.items()})
    fast = "fast_action"
    spike = (F.col("action_label") == fast) & (F.col("prev1.action_label") == fast) & (F.col("prev2.action_label") != fast)
    return rows.withColumn("spike", F.coalesce(spike, F.lit(False))).drop("prev1", "prev2", "prev3", "_step", *([embedding] if embedding else []))


def decisions(rows: DataFrame, config: SegmenterConfig) -> DataFrame:
    """Adds ``is_boundary``, ``boundary_confidence``, ``dominant`` and ``fused`` to the rows of ``signals``.

    In order: a cut, a rise into fast action, a fused score of at least threshold + margin, then the hold: a
    score within the margin opens one, the next such score commits it with the larger of both, and it lapses
    once the hold's time has passed. With rows a second apart a hold lives for two rows at most, so holds are
    the pairs (first and second, third and fourth ...) of each run of such scores at most two seconds apart.
    """
    named = {k: F.col(f"{k}_signal") for k in S.SIGNALS}
    there = F.col("camera_signal").isNotNull()
    low, high = config.boundary_threshold - config.margin, config.boundary_threshold + config.margin
    rows = rows.withColumn("raw", F.when(there, S.fused_score(named, config.weights, "image_available")).otherwise(0.0))
    rows = rows.withColumn("raw_dominant", F.when(there, S.dominant_signal(named, config.weights, "image_available")).otherwise("none"))
    hard = there & ((F.coalesce(F.col("camera_cue") == "cut", F.lit(False))) | F.col("spike") | (F.col("raw") >= high))
    zone = there & ~hard & (F.col("raw") >= low)
    rows = rows.withColumns({"hard": hard, "zone": zone})

    # Runs of held scores: these rows alone, few as a rule, are numbered over the stream.
    reach = int(config.hold_ms // 1000)
    marks = rows.filter("hard or zone").select("video_id", "second", "hard", "zone", "raw", "raw_dominant")
    w = Window.partitionBy("video_id").orderBy("second")
    new = ~(F.lag("zone", 1, False).over(w) & (F.col("second") - F.lag("second").over(w) <= reach))
    marks = marks.withColumns({"new": new.cast("int"), "raw0": F.lag("raw").over(w), "dominant0": F.lag("raw_dominant").over(w)})
    marks = marks.withColumn("run", F.sum("new").over(w)).filter("zone")
    place = F.row_number().over(Window.partitionBy("video_id", "run").orderBy("second"))
    held = marks.withColumn("place", place).filter("place % 2 = 0").select(
        "video_id",
        "second",
        F.greatest("raw", "raw0").alias("peak"),
        F.when(F.col("raw") > F.col("raw0"), F.col("raw_dominant")).otherwise(F.col("dominant0")).alias("peak_dominant"),
    )
    rows = rows.join(held, ["video_id", "second"], "left")
    cut = there & F.coalesce(F.col("camera_cue") == "cut", F.lit(False))
    fused = F.when(F.col("hard"), F.col("raw")).otherwise(F.coalesce("peak", "raw"))
    scored = S.confidence(fused, config.boundary_threshold, config.margin)
    return rows.withColumns(
        {
            "fused": fused,
            "is_boundary": F.col("hard") | F.col("peak").isNotNull(),
            "boundary_confidence": F.when(~there, 0.0).when(cut, 0.95).when(F.col("spike"), 0.85).otherwise(scored),
            "dominant": F.when(cut, "scene_change").when(there & F.col("spike"), "motion_spike").otherwise(F.coalesce("peak_dominant", "raw_dominant")),
        }
    ).drop("raw", "raw_dominant", "hard", "zone", "peak", "peak_dominant")


def last_boundaries(decided: DataFrame) -> DataFrame:
    """``decided`` with ``last_boundary``: the second of the last boundary before each second; NULL before the first."""
    at = F.when(F.col("is_boundary"), F.col("second"))
    return running_max(decided, "video_id", ["second"], F.floor(F.col("second") / SLICE_S), at, "last_boundary")
