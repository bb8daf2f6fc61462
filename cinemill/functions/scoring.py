"""Scores, labels and rules as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the sampler's reasons, in the order in which ties are decided.
REASONS = {"motion": "Fast motion", "scene": "Scene transition", "audio": "High audio energy", "subtitle": "Active subtitles", "novelty": "Novel content"}
STATIC = "Static / dialogue"
HARD_REASONS = ("scene_change", "motion_spike")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def clip(x, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(_c(x), F.lit(low)), F.lit(high))


def unit_score(x) -> Column:
    """A score as a number in [0, 1]: NULL and NaN become 0, values out of range the nearest end."""
    x = _c(x).cast("double")
    return F.coalesce(F.when(~F.isnan(x), clip(x)), F.lit(0.0))


def flag(x) -> Column:
    return F.coalesce(_c(x), F.lit(False)).cast("double")


def weighted_terms(weights: dict[str, float], motion, scene, audio, subtitle, novelty) -> dict[str, Column]:
    values = {"motion": _c(motion), "scene": flag(scene), "audio": _c(audio), "subtitle": _c(subtitle), "novelty": _c(novelty)}
    return {k: weights[k] * v for k, v in values.items()}


def importance(terms: dict[str, Column]) -> Column:
    return clip(reduce(lambda a, b: a + b, terms.values()))


def importance_to_fps(score) -> Column:
    s = _c(score)
    return F.when(s < 0.2, 0.5).when(s < 0.4, 1.0).when(s < 0.6, 2.0).when(s < 0.8, 5.0).otherwise(10.0)


def clamp_fps(fps, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _c(fps)))


def first_largest(terms: dict[str, Column]) -> Column:
    """The name of the largest term, of equal ones the first; NULL terms don't take part."""
    top = F.greatest(*terms.values()) if len(terms) > 1 else next(iter(terms.values()))
    out = F
    for name, x in terms.items():
        out = out.when(x == top, F.lit(name))
    return out


def decision_reason(terms: dict[str, Column], score) -> Column:
    named = F
    which = first_largest(terms)
    for name, text in REASONS.items():
        named = named.when(which == name, F.lit(text))
    return F.when(_c(score) < 0.2, STATIC).otherwise(named.otherwise(STATIC))


def speech_music(zero_crossing, centroid, samples) -> tuple[Column, Column]:
    """Speech and music likelihoods of an audio window by zero-crossing rate and spectral centroid."""
    z, c, n = _c(zero_crossing), _c(centroid), _c(samples)
    low, in_range = c < 3500, (z >= 0.03) & (z <= 0.20)
    speech = F.when(n < 64, 0.0).when(in_range & low, 0.75).when(in_range | low, 0.4).otherwise(0.1)
    music = F.when(n < 64, 0.0).when((c >= 1000) & ~in_range, 0.8).when(c >= 1000, 0.5).otherwise(0.2)
    return speech, music


def is_high_confidence(confidence, least: float = 0.75) -> Column:
    return F.coalesce(_c(confidence) >= least, F.lit(False))


def action_label(motion) -> Column:
    m = _c(motion)
    return F.when(m < 0.2, "static").when(m < 0.5, "walking").otherwise("fast_action")


def mood_label(audio, flux) -> Column:
    a = _c(audio)
    return F.when(a >= 0.25, "energetic").when((a < 0.08) & (_c(flux) < 0.08), "calm").otherwise("tense")


def camera_cue(scene_change, black, black_before) -> Column:
    s, b, p = (F.coalesce(_c(x), F.lit(False)) for x in (scene_change, black, black_before))
    return F.when(s & ~b, "cut").when(b, "black").when(p & ~b, "fade")


def changed(a, b) -> Column:
    return (~_c(a).eqNullSafe(_c(b))).cast("double")


def confidence(score, threshold: float, margin: float) -> Column:
    """Piecewise linear: [0, low) to [0, 0.4], [low, high) to [0.4, 0.8], [high, 1] to [0.8, 1]."""
    s, low, high = _c(score), threshold - margin, threshold + margin
    under = 0.4 * s / low if low > 0 else F.lit(0.0)
    within = 0.4 + 0.4 * (s - low) / (high - low) if high > low else F.lit(0.4)
    over = F.least(0.8 + 0.2 * (s - high) / (1 - high), F.lit(1.0)) if high < 1 else F.lit(1.0)
    return F.when(s < low, under).when(s < high, within).otherwise(over)


#: Signals in the order in which ties for the dominant one are decided; the flag says: needs an image.
SIGNALS = {"prediction_error": True, "scene": True, "dialogue": False, "emotion": False, "camera": False, "character": True, "embedding": True, "music": False}


def fused_score(signals: dict[str, Column], weights: dict[str, float], image) -> Column:
    """Weighted mean over the available signals; the character slot holds the larger of character and camera."""
    image = F.coalesce(_c(image), F.lit(True))
    score, weight = F.lit(0.0), F.lit(0.0)
    for name in ("prediction_error", "scene", "dialogue", "emotion", "embedding", "music"):
        w = F.when(image, weights[name]).otherwise(0.0) if SIGNALS[name] else F.lit(weights[name])
        score, weight = score + w * signals[name], weight + w
    score, weight = score + weights["character"] * F.greatest(signals["character"], signals["camera"]), weight + weights["character"]
    return F.when(weight > 0, clip(score / weight)).otherwise(0.0)


def dominant_signal(signals: dict[str, Column], weights: dict[str, float], image) -> Column:
    image = F.coalesce(_c(image), F.lit(True))
    terms = {}
    for name, needs in SIGNALS.items():
        x = weights["character" if name == "camera" else name] * signals[name]
        terms[name] = F.when(image, x) if needs else x
    return first_largest(terms)


def event_type(rows, dialogue, action, duration_ms, camera) -> Column:
    """From a segment's number of seconds, its shares of dialogue, fast action and camera cues, and its length."""
    return (
        F.when(F.coalesce(_c(rows), F.lit(0)) == 0, "Scene")
        .when(_c(dialogue) >= 0.4, "Dialogue")
        .when(_c(action) >= 0.4, "Action")
        .when((_c(duration_ms) < 8000) | (_c(camera) >= 0.5), "Transition")
        .otherwise("Scene")
    )


def template_summary(kind, place, most) -> Column:
    n = _c(most)
    people = (
        F.when(n.isNull(), "character data unavailable")
        .when(n == 0, "no people detected")
        .otherwise(F.concat(n.cast("string"), F.when(n == 1, " person").otherwise(" people"), F.lit(" present")))
    )
    return F.concat(_c(kind), F.lit(" event in "), F.coalesce(_c(place), F.lit("unknown")), F.lit(", "), people)


def event_importance(motion, novelty, audio, dialogue) -> Column:
    return clip(0.40 * _c(motion) + 0.25 * _c(novelty) + 0.20 * _c(audio) + 0.15 * _c(dialogue))
