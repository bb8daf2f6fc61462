"""Settings of the two stages: defaults, coercion from YAML or overrides, range checks."""

from __future__ import annotations

import dataclasses
import warnings
from dataclasses import dataclass, field

#: Raw signal weights of the segmenter; they sum to 1.05 and are normalised below.
RAW_WEIGHTS = {"prediction_error": 0.25, "scene": 0.20, "dialogue": 0.15, "emotion": 0.10, "character": 0.15, "embedding": 0.15, "music": 0.05}


def _normal(weights: dict[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    return {k: round(v / total, 6) for k, v in weights.items()}


@dataclass(frozen=True)
class SamplerConfig:
    """The defaults are fixed values. ``adaptive`` and the motion, audio and novelty thresholds are checked and carried, but steer nothing;
    a fixed rate is asked for by equal minimum and maximum."""

    adaptive: bool = True
    minimum_fps: float = 0.5
    maximum_fps: float = 10.0
    motion_threshold: float = 0.4
    scene_threshold: float = 0.45
    audio_threshold: float = 0.6
    novelty_threshold: float = 0.5
    buffer_seconds: float = 10.0
    weights: dict[str, float] = field(default_factory=lambda: {"motion": 0.3, "scene": 0.25, "audio": 0.2, "subtitle": 0.1, "novelty": 0.15})

    def __post_init__(self):
        if self.minimum_fps <= 0 or self.maximum_fps <= 0 or self.minimum_fps > self.maximum_fps:
            raise ValueError("rates must be positive and minimum_fps at most maximum_fps")
        if self.buffer_seconds <= 0:
            raise ValueError("buffer_seconds must be positive")
        for name in ("motion_threshold", "scene_threshold", "audio_threshold", "novelty_threshold"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie in [0, 1]")
        if missing := {"motion", "scene", "audio", "subtitle", "novelty"} - set(self.weights):
            raise ValueError(f"weights lack {sorted(missing)}")
        if min(self.weights.values()) < 0:
            raise ValueError("weights must not be negative")
        if abs(sum(self.weights.values()) - 1) > 0.05:
            warnings.warn("sampler weights don't sum to 1", stacklevel=3)


@dataclass(frozen=True)
class SegmenterConfig:
    """The defaults are fixed values."""

    buffer_seconds: float = 45.0
    boundary_threshold: float = 0.75
    minimum_event_s: float = 5.0
    maximum_event_s: float = 300.0
    merge_threshold: float = 0.8
    hold_ms: float = 2000.0
    margin: float = 0.05
    embedding_fusion: str = "concat"
    #: Names of the embedding adapter's model; carried for it, the engine itself reads neither.
    clip_model: str = "ViT-B-32"
    clip_pretrained: str = "openai"
    weights: dict[str, float] = field(default_factory=lambda: _normal(RAW_WEIGHTS))

    def __post_init__(self):
        if not 0 < self.boundary_threshold <= 1 or not 0 <= self.merge_threshold <= 1:
            raise ValueError("boundary_threshold must lie in (0, 1], merge_threshold in [0, 1]")
        if self.buffer_seconds <= 0:
            raise ValueError("buffer_seconds must be positive")
        if not 0 < self.minimum_event_s < self.maximum_event_s:
            raise ValueError("minimum_event_duration must be positive and below maximum_event_duration")
        if self.embedding_fusion not in ("concat", "mean"):
            raise ValueError("embedding_fusion is concat or mean")
        if abs(sum(self.weights.values()) - 1) > 1e-4:
            raise ValueError("weights must sum to 1")


#: Names in settings files that differ from the fields.
_ALIASES = {"minimum_event_duration": "minimum_event_s", "maximum_event_duration": "maximum_event_s", "confidence_margin": "margin", "confidence_hold_seconds": "hold_ms"}


def load(kind: type, path: str | None = None, **overrides):
    """A ``kind`` from a YAML file and overrides (None means: not given); unknown names are an error."""
    values: dict = {}
    if path:
        import yaml

        with open(path, encoding="utf-8") as f:
            values = yaml.safe_load(f) or {}
    values |= {k: v for k, v in overrides.items() if v is not None}
    fields = {f.name: f for f in dataclasses.fields(kind)}
    out = {}
    for name, value in values.items():
        to = name if name in fields else _ALIASES.get(name, name)
        if to not in fields:
            raise ValueError(f"unknown setting {name}")
        if to == "weights":
            out[to] = {k: float(v) for k, v in value.items()}
            if kind is SegmenterConfig and abs(sum(out[to].values()) - 1) > 0.01:
                out[to] = _normal(out[to])
        elif fields[to].type == "float":
            out[to] = float(value) * (1000 if name == "confidence_hold_seconds" else 1)
        elif fields[to].type == "bool":
            out[to] = value if isinstance(value, bool) else str(value).lower() in ("1", "true", "yes")
        else:
            out[to] = str(value)
    return kind(**out)
