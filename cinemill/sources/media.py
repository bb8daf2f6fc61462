"""Media behind injectable adapters, and a Python data source over them.

No codec, speech, vision or language model is assumed to be there. An adapter is any picklable object with the
method named below; without one the tables hold their precomputed columns, or are empty.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FRAME = "video_id string, frame_id long, timestamp_ms double, h int, w int, rgb binary"


class Decoder(Protocol):
    def probe(self, path: str) -> dict: ...
    def frames(self, path: str) -> Iterator[tuple[float | None, int, int, bytes]]: ...
    def samples(self, path: str) -> tuple[int, list[float]]: ...


class Transcriber(Protocol):
    def cues(self, path: str) -> list[tuple[float, float, str]] | None: ...


class Embedder(Protocol):
    def embed(self, image) -> list[float] | None: ...


@dataclass(frozen=True)
class Adapters:
    """What is installed beside the engine; all optional."""

    decoder: Decoder | None = None
    transcriber: Transcriber | None = None
    embedder: Embedder | None = None
    captioner: object | None = None


def rising_frames(frames, fps: float):
    """(number, time, h, w, rgb) of decoded frames: a missing time is one frame after the last, an unreadable frame
    (None) is passed over, as is one whose time doesn't rise."""
    step, last, number = (1000.0 / fps if fps > 0 else 40.0), None, 0
    for frame in frames:
        if frame is None:
            continue
        at, h, w, rgb = frame
        at = (0.0 if last is None else last + step) if at is None else float(at)
        if last is not None and at <= last:
            continue
        yield number, at, h, w, rgb
        last, number = at, number + 1


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Frames(DataSourceReader):
    def __init__(self, options):
        self.paths, self.decoder = options["paths"], options["decoder"]

    def partitions(self):
        return [_Part(p) for p in self.paths]

    def read(self, part):
        if part is None:
            return
        name = os.path.splitext(os.path.basename(part.path))[0]
        fps = float(self.decoder.probe(part.path).get("fps") or 0.0)
        for number, at, h, w, rgb in rising_frames(self.decoder.frames(part.path), fps):
            yield name, number, at, h, w, rgb


def frame_source(paths: list[str], decoder: Decoder) -> type[DataSource]:
    """A data source ``cinemill_frames`` over ``paths``, one partition per file."""

    class Frames(DataSource):
        @classmethod
        def name(cls):
            return "cinemill_frames"

        def schema(self):
            return FRAME

        def reader(self, schema):
            return _Frames({"paths": paths, "decoder": decoder})

    return Frames


def read_frames(spark: SparkSession, paths: list[str], decoder: Decoder) -> DataFrame:
    spark.dataSource.register(frame_source(paths, decoder))
    return spark.read.format("cinemill_frames").load()


def probe(spark: SparkSession, paths: list[str], decoder: Decoder) -> DataFrame:
    """One row of container metadata per file; NULLs where the adapter says nothing."""
    fields = "path string, fps double, duration_ms double, width int, height int, codec string, bitrate long"
    names = [f.split()[0] for f in fields.split(", ")[1:]]

    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame([[p, *[decoder.probe(p).get(n) for n in names]] for p in b["path"]], columns=["path", *names])

    return spark.createDataFrame([(p,) for p in paths], "path string").mapInPandas(run, fields)


def audio_samples(spark: SparkSession, paths: list[str], decoder: Decoder) -> DataFrame:
    """``video_id, position, value``: mono samples, each stream scaled to a peak of 1; empty without sound."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            for p in b["path"]:
                _, x = decoder.samples(p)
                x = np.asarray(x, dtype=np.float32)
                peak = np.abs(x).max(initial=0.0)
                yield pd.DataFrame({"video_id": os.path.splitext(os.path.basename(p))[0], "position": np.arange(len(x)), "value": x / peak if peak > 0 else x})

    return spark.createDataFrame([(p,) for p in paths], "path string").mapInPandas(run, "video_id string, position long, value float")


def resampled(x, rate: int, to: int):
    """Samples at another rate, by linear interpolation."""
    import numpy as np

    x = np.asarray(x, dtype=np.float64)
    n = int(round(len(x) * to / rate))
    return np.interp(np.arange(n) * rate / to, np.arange(len(x)), x) if len(x) else x


def wav_bytes(x, rate: int, to: int = 16_000) -> bytes:
    """A mono WAV file of 16 bits a sample; what exceeds [-1, 1] is clipped."""
    import io
    import wave

    import numpy as np

    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(to)
        f.writeframes((np.clip(resampled(x, rate, to), -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def wav_files(spark: SparkSession, paths: list[str], decoder: Decoder, rate: int = 16_000) -> DataFrame:
    """``video_id, wav``: every file's sound as a WAV of ``rate`` samples a second; no row without sound."""

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for p in b["path"]:
                own, x = decoder.samples(p)
                if len(x):
                    rows.append((os.path.splitext(os.path.basename(p))[0], wav_bytes(x, own, rate)))
            if rows:
                yield pd.DataFrame(rows, columns=["video_id", "wav"])

    return spark.createDataFrame([(p,) for p in paths], "path string").mapInPandas(run, "video_id string, wav binary")


def first_cues(path: str, transcribers: list[Transcriber]) -> list[tuple[float, float, str]]:
    """The cues of the first adapter that gives any with a text; one that fails or gives none passes on to the next."""
    for t in transcribers:
        try:
            cues = [c for c in t.cues(path) or [] if c[2] and c[2].strip()]
        except Exception:  # noqa: BLE001 - the next adapter may do
            continue
        if cues:
            return cues
    return []


def transcribe(spark: SparkSession, paths: list[str], transcriber: Transcriber | list[Transcriber] | None) -> DataFrame:
    """Cues by a speech adapter, or the first of several that gives any; empty without one, or where none does."""
    schema = "video_id string, cue_idx int, start_ms double, end_ms double, text string"
    chain = [] if transcriber is None else transcriber if isinstance(transcriber, list) else [transcriber]
    if not chain:
        return spark.createDataFrame([], schema)

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [(os.path.splitext(os.path.basename(p))[0], i, *c) for p in b["path"] for i, c in enumerate(first_cues(p, chain))]
            yield pd.DataFrame(rows, columns=["video_id", "cue_idx", "start_ms", "end_ms", "text"])

    return spark.createDataFrame([(p,) for p in paths], "path string").mapInPandas(run, schema)


def load_gallery(spark: SparkSession, arguments: list[str], embedder: Embedder | None) -> DataFrame:
    """``name, reference`` of arguments ``path=name``; photos that can't be read or show nothing are left out."""
    schema = "name string, reference array<float>"
    pairs = [tuple(a.rsplit("=", 1)) for a in arguments if "=" in a]
    if embedder is None or not pairs:
        return spark.createDataFrame([], schema)
    rows = []
    for path, name in pairs:
        try:
            with open(path, "rb") as f:
                vector = embedder.embed(f.read())
        except OSError:
            continue
        if vector is not None:
            rows.append((name, [float(x) for x in vector]))
    return spark.createDataFrame(rows, schema)


def write_frames(frames: DataFrame, folder: str, encode) -> None:
    """Files <stream>/frame_%08d.jpg of kept frames under a shared folder; ``encode(h, w, rgb) -> bytes``.

    Every stream has a folder of its own. A file appears under its name only when it is whole, so a task that is
    run again writes the same file.
    """

    def save(rows):
        for r in rows:
            own = os.path.join(folder, quote(str(r.video_id), safe=""))
            os.makedirs(own, exist_ok=True)
            path = os.path.join(own, f"frame_{r.frame_id:08d}.jpg")
            with open(f"{path}.{os.getpid()}", "wb") as f:
                f.write(encode(r.h, r.w, r.rgb))
            os.replace(f"{path}.{os.getpid()}", path)

    frames.select("video_id", "frame_id", "h", "w", "rgb").foreachPartition(save)


def seek_images(packets: DataFrame, frames: DataFrame, key: str = "video_id", slice_ms: float = 600_000.0) -> DataFrame:
    """Packets with the image of the last frame at or before their time (NULL before the first frame).

    An as-of join without a range join: frames and packets are sorted together and the last frame is carried on,
    inside slices of a stream. Packets before their slice's first frame get the last image of the slices before,
    of which only one for each slice meets per stream.
    """
    left = packets.select(key, "timestamp_ms", F.lit(1).alias("_side"), F.struct(*packets.columns).alias("_p"), F.lit(None).cast("struct<h:int,w:int,rgb:binary>").alias("_f"))
    right = frames.select(key, "timestamp_ms", F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_p"].dataType).alias("_p"), F.struct(F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), "rgb").alias("_f"))
    both = left.unionByName(right).withColumn("_s", F.floor(F.col("timestamp_ms") / slice_ms))
    w = Window.partitionBy(key, "_s").orderBy("timestamp_ms", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("image", F.last("_f", ignorenulls=True).over(w)).filter("_side = 1")
    slices = both.groupBy(key, "_s").agg(F.max_by("_f", F.when(F.col("_side") == 0, F.col("timestamp_ms"))).alias("_l"))
    before = Window.partitionBy(key).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(F.col(key).alias("_k"), F.col("_s").alias("_t"), F.last("_l", ignorenulls=True).over(before).alias("_l"))
    out = found.join(slices, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_s") == F.col("_t")))
    return out.select("_p.*", F.coalesce("image", "_l").alias("image"))
