"""Audio features of fixed windows of samples: loudness, cepstrum, onset flux, zero crossings, spectral centroid.

Windows are gathered as arrays and go through numpy in Arrow batches. The onset flux compares the spectrum at
the start of a window with that at the start of the one before; of a neighbour only half a frame is needed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinemill.functions import scoring as S
from cinemill.operators.sliced import neighbours
from cinemill.session import cut


@dataclass(frozen=True)
class Spectrum:
    """``rate``: samples a second; ``frame`` and ``hop``: of the Fourier transform; ``bands`` of the mel scale;
    ``cepstrum``: coefficients kept; ``floor_db``: what is so far below the loudest band counts as that."""

    rate: int = 16_000
    frame: int = 2048
    hop: int = 512
    bands: int = 128
    cepstrum: int = 13
    floor_db: float = 80.0


@lru_cache(maxsize=8)
def mel_filters(p: Spectrum) -> np.ndarray:
    """Triangles of equal area over the mel scale that is linear up to 1000 Hz and logarithmic above."""
    linear, corner, step = 200.0 / 3, 1000.0, np.log(6.4) / 27
    to_mel = lambda f: f / linear if f < corner else corner / linear + np.log(f / corner) / step
    mels = np.linspace(0, to_mel(p.rate / 2), p.bands + 2)
    edges = np.where(mels < corner / linear, mels * linear, corner * np.exp(step * (mels - corner / linear)))
    at = np.linspace(0, p.rate / 2, p.frame // 2 + 1)
    rise = (at[None, :] - edges[:-2, None]) / np.diff(edges)[:-1, None]
    fall = (edges[2:, None] - at[None, :]) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def decibels(power: np.ndarray, floor_db: float | None) -> np.ndarray:
    out = 10 * np.log10(np.maximum(power, 1e-10))
    return out if floor_db is None else np.maximum(out, out.max(initial=-np.inf) - floor_db)


def _frames(x: np.ndarray, p: Spectrum, mode: str) -> np.ndarray:
    return sliding_window_view(np.pad(x, p.frame // 2, mode=mode), p.frame)[:: p.hop]


def magnitudes(x: np.ndarray, p: Spectrum) -> np.ndarray:
    """|Fourier transform| of the centred frames of ``x``, a row each."""
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(p.frame) / p.frame)
    return np.abs(np.fft.rfft(_frames(x, p, "constant") * hann, axis=1))


def cepstrum(size: np.ndarray, p: Spectrum) -> np.ndarray:
    """The mean of the first cepstral coefficients over the frames."""
    loud = decibels((size**2) @ mel_filters(p).T, p.floor_db)
    n = p.bands
    basis = np.cos(np.pi * np.arange(p.cepstrum)[:, None] * (2 * np.arange(n) + 1) / (2 * n)) * np.sqrt(2 / n)
    basis[0] /= np.sqrt(2)
    return (loud @ basis.T).mean(axis=0)


def zero_crossings(x: np.ndarray, p: Spectrum) -> float:
    """The mean share of samples that differ in sign from the one before, over frames."""
    x = np.where(np.abs(x) <= 1e-10, 0.0, x)
    sign = np.signbit(_frames(x, p, "edge"))
    return float((sign[:, 1:] != sign[:, :-1]).sum(axis=1).mean() / p.frame)


def centroid(size: np.ndarray, p: Spectrum) -> float:
    """The mean over frames of the frequency's mean weighted by magnitude; silent frames count as 0."""
    total = size.sum(axis=1)
    at = np.linspace(0, p.rate / 2, p.frame // 2 + 1)
    return float(np.where(total > 0, (size @ at) / np.where(total > 0, total, 1), 0).mean())


_MEASURED = "cepstrum array<float>, zero_crossing double, centroid double, n long, rms double"


def measure(x: np.ndarray, p: Spectrum) -> tuple:
    size = magnitudes(x, p)
    return cepstrum(size, p).astype(np.float32), zero_crossings(x, p), centroid(size, p), len(x), float(np.sqrt((x * x).mean()))


def audio_features(samples: DataFrame, key: str, position: str, value: str, *, window_ms: float = 250.0, spectrum: Spectrum | None = None) -> DataFrame:
    """``key, idx, start_ms, end_ms, energy, silence, cepstrum, spectral_flux, zero_crossing, centroid, speech, music``.

    A row per whole window of ``window_ms``. ``energy`` is its RMS through five times the stream's, at most 1;
    ``spectral_flux`` the mean rise of the mel bands in decibels since the start of the window before through the
    stream's largest. NULL and NaN samples count as 0, missing positions are closed up inside their window. A
    window must be at least half a frame long.
    """
    p = spectrum or Spectrum()
    window, half = int(p.rate * window_ms / 1000), p.frame // 2
    if window < half:
        raise ValueError("a window must hold at least half a frame")
    x = F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = samples.filter(F.col(position).isNotNull()).select(F.col(key).alias("key"), F.floor(F.col(position) / window).alias("idx"), F.col(position).alias("at"), x.alias("x"))
    rows = rows.groupBy("key", "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda v: v["x"]).alias("x"))

    @F.pandas_udf(_MEASURED)
    def measured(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(np.asarray(v), p) for v in batch], columns=[c.split()[0] for c in _MEASURED.split(", ")])

    rows = cut(rows.select("key", "idx", measured("x").alias("m"), F.slice("x", 1, half).alias("head"), F.slice("x", F.greatest(F.size("x") - half + 1, F.lit(1)), half).alias("tail")).select("key", "idx", "m.*", "head", "tail"))

    @F.pandas_udf("array<double>")
    def opening(head: pd.Series, before: pd.Series) -> pd.Series:
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(p.frame) / p.frame)
        frames = np.zeros((len(head), p.frame))
        for k, (a, b) in enumerate(zip(before, head)):
            if a is not None:
                frames[k, half - len(a) : half] = a
            frames[k, half : half + len(b)] = b
        return pd.Series(list(decibels((np.abs(np.fft.rfft(frames * hann, axis=1)) ** 2) @ mel_filters(p).T, None)))

    slice_ = F.floor(F.col("idx") / 4096)
    near = neighbours(rows, "key", ["idx"], slice_, carry=["idx", "tail"])
    near = near.withColumn("before", F.when(F.col("prev1.idx") == F.col("idx") - 1, F.col("prev1.tail")))
    bands = cut(near.withColumn("db", opening("head", "before")).drop("prev1", "head", "tail", "before"))
    most = bands.groupBy("key").agg((F.max(F.array_max("db")) - p.floor_db).alias("floor"), (F.sqrt(F.sum(F.col("rms") * F.col("rms") * F.col("n")) / F.sum("n")) * 5 + 1e-9).alias("loudest"))
    bands = neighbours(bands.join(most, "key"), "key", ["idx"], slice_, carry=["idx", "db"])

    @F.pandas_udf("double")
    def rise(now: pd.Series, last: pd.Series, floor: pd.Series) -> pd.Series:
        out = [0.0 if b is None else float(np.maximum(np.maximum(a, f) - np.maximum(b, f), 0).mean()) for a, b, f in zip(now, last, floor)]
        return pd.Series(out, dtype="float64")

    last = F.when(F.col("prev1.idx") == F.col("idx") - 1, F.col("prev1.db"))
    bands = cut(bands.withColumn("rise", rise("db", last, "floor")).drop("db", "prev1"))
    top = bands.groupBy("key").agg(F.max("rise").alias("top"))
    speech, music = S.speech_music("zero_crossing", "centroid", "n")
    return bands.join(top, "key").filter(F.col("n") == window).select(
        F.col("key").alias(key),
        "idx",
        (F.col("idx") * window_ms).alias("start_ms"),
        ((F.col("idx") + 1) * window_ms).alias("end_ms"),
        S.clip(F.col("rms") / F.col("loudest")).alias("energy"),
        (F.col("rms") < 0.02).alias("silence"),
        "cepstrum",
        S.clip(F.col("rise") / (F.col("top") + 1e-9)).alias("spectral_flux"),
        "zero_crossing",
        "centroid",
        speech.alias("speech"),
        music.alias("music"),
    )
