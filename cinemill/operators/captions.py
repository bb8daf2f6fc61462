"""What models say about images - captions, scene labels, faces - as chains of optional adapters with fixed fallbacks.

An adapter is any picklable object; it is loaded where the rows are. Without one, or where it fails, every chain
ends in what needs no model: the template, the colour heuristic, no faces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinemill.functions import scoring as S
from cinemill.functions import text as X
from cinemill.operators.pixels import decode, heuristic_scene
from cinemill.session import cut

BLACK = 5  # an image without a value of at least this shows nothing


class Captioner(Protocol):
    def ready(self) -> bool: ...
    def ask(self, image, prompt: str, system: str | None, most_tokens: int) -> str: ...


class Detector(Protocol):
    def ready(self) -> bool: ...
    def detect(self, image) -> list[tuple[float, float, float, float]]: ...


@dataclass(frozen=True)
class Router:
    """The captioner in use, by name; a name without a captioner means that there is none. Failures say nothing."""

    captioners: dict[str, Captioner | None] = field(default_factory=dict)
    backend: str = "none"

    def __post_init__(self):
        name = self.backend.lower().strip()
        if name != "none" and name not in self.captioners:
            raise ValueError(f"unknown backend {self.backend}; there are {sorted(self.captioners)}")
        object.__setattr__(self, "backend", name)

    def using(self, backend: str) -> Router:
        return Router(self.captioners, backend)

    def available(self) -> bool:
        one = self.captioners.get(self.backend)
        try:
            return one is not None and bool(one.ready())
        except Exception:  # noqa: BLE001 - an adapter's failure means that there is none
            return False

    def ask(self, image, prompt: str, system: str | None = None, most_tokens: int = 60) -> str:
        try:
            return str(self.captioners[self.backend].ask(image, prompt, system, most_tokens) or "") if self.available() else ""
        except Exception:  # noqa: BLE001
            return ""

    def mode(self) -> str:
        return self.backend if self.available() else "none" if self.captioners.get(self.backend) is None else "unavailable"


def shows_something(image: np.ndarray | None) -> bool:
    return image is not None and image.ndim == 3 and image.size > 0 and int(image.max()) >= BLACK


def _image(x) -> np.ndarray | None:
    """A struct of h, w and rgb as an array; None if it is none or doesn't fit."""
    if x is None or x["rgb"] is None or x["h"] is None or x["w"] is None:
        return None
    h, w = int(x["h"]), int(x["w"])
    return decode(h, w, bytes(x["rgb"])) if h > 0 and w > 0 and len(x["rgb"]) == h * w * 3 else None


def _with(rows: DataFrame, add, fields: str) -> DataFrame:
    """``rows`` with the columns that ``add(frame)`` gives, batch by batch."""
    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string(fields).fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**add(b))[schema.names]

    return rows.mapInPandas(run, schema)


def system_prompt(dialogue, labels) -> Column:
    """What a captioner is told besides the image; dialogue and people only where they are known."""
    d, people = F.col(dialogue), F.col(labels)
    return F.concat(
        F.lit("Describe in one plain sentence what can be seen."),
        F.coalesce(F.when(F.length(d) > 0, F.concat(F.lit(' These words are spoken: "'), d, F.lit('". Add no others.'))), F.lit("")),
        F.coalesce(F.when(F.size(people) > 0, F.concat(F.lit(" The people are "), F.array_join(people, ", "), F.lit("; call them so."))), F.lit("")),
    )


def summarised(events: DataFrame, router: Router, *, image: str = "key_image", calls=None) -> DataFrame:
    """``events`` with ``summary``: an accepted caption of the key image, else the template.

    No image, a black one or no captioner gives the template without asking; a caption must pass the gates of
    ``accepted_text``. ``calls``: an accumulator that counts the events, each asked about once.
    """
    rows = events.withColumn("_template", S.template_summary("event_type", "location_label", "max_characters_seen"))
    rows = rows.withColumn("_system", system_prompt("dialogue_text", "character_labels"))

    def raw(b: pd.DataFrame) -> dict:
        if calls is not None:
            calls.add(len(b))
        able, out = router.available(), []
        for i, system, said in zip(b[image], b["_system"], b["dialogue_text"]):
            picture = _image(i) if able else None
            out.append(router.ask(picture, "What happens in this image?", system, 130 if said else 100) if shows_something(picture) else None)
        return {"_raw": pd.Series(out, index=b.index, dtype=object)}

    rows = cut(_with(rows, raw, "_raw string"))  # written once: a model is asked once
    return rows.withColumn("summary", X.accepted_text("_raw", F.col("_template"))).drop("_raw", "_template", "_system")


def zero_shot(vector: np.ndarray, labels: list[str], table: np.ndarray) -> str:
    """The label whose vector has the largest product with ``vector``, of equal ones the first."""
    return labels[int((table @ vector).argmax())]


def scene_labels(frames: DataFrame, labels: list[str], *, image: str = "image", router: Router | None = None, vector: str | None = None, table: dict[str, list[float]] | None = None) -> DataFrame:
    """``frames`` with ``scene_label``: unknown without an image or for a black one; else what the captioner names
    among ``labels``; without a captioner the nearest label vector of ``table`` to the column ``vector``; else by colour."""
    router = router or Router()
    names = list(table or {})
    matrix = np.array([table[n] for n in names], dtype=np.float64) if names else None

    def add(b: pd.DataFrame) -> dict:
        able, out = router.available(), []
        vectors = b[vector] if vector else [None] * len(b)
        for i, v in zip(b[image], vectors):
            picture = _image(i)
            answer = None
            if not shows_something(picture):
                label = "unknown"
            elif able:
                label, answer = None, router.ask(picture, "Which of these places is it: " + ", ".join(labels) + "?")
            elif matrix is not None and v is not None and len(v) == matrix.shape[1]:
                length = float(np.linalg.norm(v))
                label = zero_shot(np.asarray(v) / (length or 1.0), names, matrix)
            else:
                label = heuristic_scene(picture)
            out.append((label, answer))
        return {"_label": pd.Series([x for x, _ in out], index=b.index, dtype=object), "_answer": pd.Series([x for _, x in out], index=b.index, dtype=object)}

    rows = _with(frames, add, "_label string, _answer string")
    return rows.withColumn("scene_label", F.coalesce("_label", X.vocabulary_match("_answer", labels))).drop("_label", "_answer")


def detected_faces(frames: DataFrame, detectors: list[Detector], *, image: str = "image") -> DataFrame:
    """``frames`` with ``boxes`` (x, y, w, h) by the first detector that is ready, and their number ``faces``.

    Without an image, for a black one, without a detector or where it fails there are none.
    """

    def add(b: pd.DataFrame) -> dict:
        chosen, out = None, []
        for d in detectors:
            try:
                if d.ready():
                    chosen = d
                    break
            except Exception:  # noqa: BLE001 - the next one may do
                continue
        for i in b[image]:
            picture, found = _image(i), []
            if chosen is not None and shows_something(picture):
                try:
                    found = [dict(zip("xywh", map(float, box[:4]))) for box in chosen.detect(picture)]
                except Exception:  # noqa: BLE001
                    found = []
            out.append(found)
        return {"boxes": pd.Series(out, index=b.index, dtype=object), "faces": pd.Series([len(x) for x in out], index=b.index, dtype="int32")}

    return _with(frames, add, "boxes array<struct<x:double,y:double,w:double,h:double>>, faces int")


def crop(image: np.ndarray, box) -> np.ndarray | None:
    """The part of an image in a box, as far as it lies inside; None if nothing does."""
    h, w = image.shape[:2]
    x1, y1 = max(0, int(box["x"])), max(0, int(box["y"]))
    x2, y2 = min(w, int(box["x"]) + int(box["w"])), min(h, int(box["y"]) + int(box["h"]))
    return image[y1:y2, x1:x2] if x2 > x1 and y2 > y1 else None


def face_vectors(frames: DataFrame, embedder, *, image: str = "image", boxes: str = "boxes") -> DataFrame:
    """``frames`` with ``face_embeddings``: unit vectors of the boxes' crops; boxes outside the image, or which the
    embedder (``embed(crop) -> vector or None``) makes nothing of, are left out. Without an embedder there are none."""

    def add(b: pd.DataFrame) -> dict:
        out = []
        for i, own in zip(b[image], b[boxes]):
            picture, found = _image(i), []
            if picture is not None and embedder is not None and own is not None:
                for box in own:
                    part = crop(picture, box)
                    v = None if part is None else embedder.embed(part)
                    if v is not None and (length := float(np.linalg.norm(v))) > 0:
                        found.append((np.asarray(v, dtype=np.float64) / length).astype(np.float32).tolist())
            out.append(found)
        return {"face_embeddings": pd.Series(out, index=b.index, dtype=object)}

    return _with(frames, add, "face_embeddings array<array<float>>")
