"""One feature row per second of a stream, gaps included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinemill.functions import scoring as S
from cinemill.operators.sliced import neighbours

SLICE_S = 3600


def majority_labels(df: DataFrame, keys: list[str], label: str, order: list[str], name: str) -> DataFrame:
    """``keys, name``: the most frequent label, of equally frequent ones the first seen; NULL labels don't count."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_o"))
    best = counts.groupBy(*keys).agg(F.max("_n").alias("_most"), F.collect_list(F.struct("_n", "_o", F.col(label).alias("_l"))).alias("_a"))
    top = F.filter("_a", lambda x: x["_n"] == F.col("_most"))
    first = F.array_sort(F.transform(top, lambda x: F.struct(x["_o"].alias("o"), x["_l"].alias("l"))))
    return best.select(*keys, F.get(first, F.lit(0))["l"].alias(name))


def per_second(packets: DataFrame, *, unit_ms: int = 1000, carry: bool = True) -> DataFrame:
    """Feature rows of packets (video_id, frame_id, timestamp_ms, the scores, scene_change, subtitle_text).

    Optional columns: ``scene_label``, ``faces`` (count, NULL if not looked at), ``black``, ``has_image``; without
    them the label is unknown, the count NULL ("not observed", unlike 0), nothing is black and no image there.

    ``image``: then ``last_image``, the last one of the second that isn't NULL, stands for it.

    A second's scores are means, its dialogue the distinct texts in order, its count the largest. A second
    without packets repeats the one before, but for the camera cue. Spectral flux is the change of mean
    loudness from the last observed second. ``unit_ms`` is the width of the buckets called seconds here.
    """
    defaults = {"scene_label": F.lit(None).cast("string"), "faces": F.lit(None).cast("int"), "black": F.lit(False), "has_image": F.lit(False)}
    p = packets.withColumns({c: x for c, x in defaults.items() if c not in packets.columns})
    p = p.withColumns({"second": F.floor(F.col("timestamp_ms") / unit_ms), "ord": F.struct("timestamp_ms", "frame_id")})
    keys, images = ["video_id", "second"], ["last_image"] if "image" in packets.columns else []
    text = F.when(F.length("subtitle_text") > 0, F.struct("ord", F.col("subtitle_text").alias("x")))
    texts = F.array_distinct(F.transform(F.array_sort(F.collect_list(text)), lambda t: t["x"]))
    cut = F.coalesce(F.col("scene_change"), F.lit(False)) & ~F.coalesce("black", F.lit(False))
    rows = p.groupBy(*keys).agg(
        F.avg("motion_score").alias("motion_score"),
        F.avg("novelty_score").alias("novelty_score"),
        F.avg("audio_energy").alias("audio_energy"),
        F.nullif(F.array_join(texts, " | "), F.lit("")).alias("dialogue_text"),
        F.max("faces").alias("character_count"),
        F.bool_or("has_image").alias("image_available"),
        # The first packet with a cue decides; whether a packet fades in depends on the second before only.
        F.min(F.when(cut, F.col("ord"))).alias("first_cut"),
        F.min(F.when(F.col("black"), F.col("ord"))).alias("first_black"),
        F.min(F.when(~F.coalesce("black", F.lit(False)), F.col("ord"))).alias("first_lit"),
        F.max_by(F.coalesce("black", F.lit(False)), "ord").alias("last_black"),
        F.max_by("subtitle_text", F.when(F.col("subtitle_text").isNotNull(), F.col("ord"))).alias("last_text"),
        F.count("*").alias("packets"),
        *([F.max_by("image", F.when(F.col("image").isNotNull(), F.col("ord"))).alias("last_image")] if images else []),
    )
    if "scene_label" in packets.columns:
        rows = rows.join(majority_labels(p, keys, "scene_label", ["timestamp_ms", "frame_id"], "scene_label"), keys, "left")
    else:
        rows = rows.withColumn("scene_label", F.lit(None).cast("string"))
    slice_ = F.floor(F.col("second") / SLICE_S)
    rows = neighbours(rows, "video_id", ["second"], slice_, back=1, ahead=1, carry=["second", "audio_energy", "last_black"])
    flux = F.coalesce(F.abs(F.col("audio_energy") - F.col("prev1.audio_energy")), F.lit(0.0))
    # Within a second: the earliest of cut and black, and of fade if the second before ended in black.
    first_fade = F.when(F.coalesce(F.col("prev1.last_black"), F.lit(False)), F.col("first_lit"))
    first = F.least("first_cut", "first_black", first_fade)
    cue = F.when(F.col("first_cut") == first, "cut").when(F.col("first_black") == first, "black").when(first_fade == first, "fade")
    rows = rows.withColumns(
        {
            "spectral_flux": flux,
            "camera_cue": cue,
            "scene_label": F.coalesce("scene_label", F.lit("unknown")),
            "action_label": S.action_label("motion_score"),
            "dialogue_present": F.col("dialogue_text").isNotNull(),
        }
    )
    rows = rows.withColumn("music_mood", S.mood_label("audio_energy", "spectral_flux"))
    until = F.coalesce(F.col("next1.second") - 1, F.col("second")) if carry else F.col("second")
    at = F.explode(F.sequence(F.col("second"), until)).alias("at")
    columns = ["scene_label", "character_count", "action_label", "dialogue_present", "dialogue_text", "camera_cue", "music_mood"]
    scores = ["motion_score", "novelty_score", "audio_energy", "spectral_flux"]
    rows = rows.select("video_id", "second", at, *columns, *scores, "image_available", "last_text", "packets", *images)
    return rows.select(
        "video_id",
        F.col("at").alias("second"),
        (F.col("at") * float(unit_ms)).alias("timestamp_ms"),
        *[c for c in columns if c != "camera_cue"],
        F.when(F.col("at") == F.col("second"), F.col("camera_cue")).alias("camera_cue"),
        *scores,
        "image_available",
        (F.col("at") != F.col("second")).alias("carried"),
        F.when(F.col("at") == F.col("second"), F.col("last_text")).alias("last_text"),
        F.when(F.col("at") == F.col("second"), F.col("packets")).otherwise(0).alias("packets"),
        *[F.when(F.col("at") == F.col("second"), F.col(c)).alias(c) for c in images],
    )
