"""Repetition inside a single document, by compression bands.

Two kinds of zstandard ratio are taken, for the whole document and for fixed chunks of it:

* the *text* ratio, of the UTF-8 bytes: small for repetitive text, near or over 1 for noise;
* the *phrase* ratio, of the words, each replaced by four pseudo-random bytes. A new word can't be
  compressed and every word weighs the same, so this ratio follows the share of words that belong to
  repeated phrases and hardly anything else (not the language, not the length of its words).

Limits hang on the document's length, as a frame's fixed bytes weigh more in a short one. A document
whose phrase ratio is beyond the limit of its band can't reach the asked share of repeated words: with
share ``s`` of ``n`` words repeated in runs of at least ``run`` words, zstandard needs at most
``4 n (1 - s)`` bytes of literals, about 5 bytes for each of at most ``s n / run`` matches, and 24 bytes
of frame. Only the others can be repetitive. The exact count, which is linear, is made for every text.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinemill.session import free_name

_WORD = re.compile("[a-z]+")
_MATCH_BYTES, _FRAME_BYTES = 5, 24
#: Bytes of codes from which the window must be widened, and the level then.
_WINDOW, _LONG_LEVEL = 4_000_000, 12
_SCHEMA = (
    "n_words long, n_bytes long, band int, text_ratio double, chunk_ratio_min double, chunk_ratio_max double,"
    " phrase_ratio double, phrase_limit double, too_regular boolean, too_noisy boolean, repeated_words long, repeated_share double, repetitive boolean"
)


@dataclass(frozen=True)
class Bands:
    """Parameters of the operator; ``edges`` are the lower ends of the length bands, in words."""

    share: float = 0.35
    run: int = 4
    least_words: int = 12
    edges: tuple[int, ...] = (12, 25, 50, 100, 250, 1000, 10_000)
    chunk_bytes: int = 1024
    regular: tuple[float, ...] = (0.45, 0.40, 0.35, 0.30, 0.22, 0.15, 0.10)
    noisy: tuple[float, ...] = (1.30, 1.15, 1.05, 0.95, 0.90, 0.85, 0.80)
    level: int = 3
    phrase_level: int = 19

    def band(self, n: int) -> int:
        return sum(n >= e for e in self.edges) - 1

    def limit(self, n: int) -> float:
        """The largest phrase ratio with which ``n`` words can hold the asked share."""
        low = self.edges[self.band(n)]
        return (1 - self.share) + _MATCH_BYTES * self.share / (4 * self.run) + _FRAME_BYTES / (4 * low)


def repeated_words(words: list[str], run: int) -> int:
    """Words in a run of ``run`` words that stood in this order before, starting at an earlier word."""
    n, first, count, covered = len(words), {}, 0, 0
    for i in range(n - run + 1):
        if first.setdefault(tuple(words[i : i + run]), i) < i:
            count += i + run - max(i, covered)
            covered = i + run
    return count


def _code(k: int) -> bytes:
    """Four pseudo-random bytes for the k-th different word (a bijection on 32 bits, so no two agree)."""
    k = (k + 0x9E3779B9) & 0xFFFFFFFF
    k = ((k ^ (k >> 16)) * 0x85EBCA6B) & 0xFFFFFFFF
    k = ((k ^ (k >> 13)) * 0xC2B2AE35) & 0xFFFFFFFF
    return struct.pack("<I", k ^ (k >> 16))


def _phrase_ratio(words: list[str], packer) -> float:
    codes: dict[str, bytes] = {}
    raw = b"".join([codes.get(w) or codes.setdefault(w, _code(len(codes))) for w in words])
    if len(raw) > _WINDOW:  # a repeat may lie further back than the level's window reaches
        import zstandard

        wide = zstandard.ZstdCompressionParameters.from_level(_LONG_LEVEL, window_log=min(30, len(raw).bit_length()), enable_ldm=True, ldm_min_match=16)
        packer = zstandard.ZstdCompressor(compression_params=wide)
    return len(packer.compress(raw)) / len(raw)


def measure_text(text: str | None, p: Bands, packers) -> tuple:
    """The values of ``_SCHEMA`` for one text."""
    plain, strong = packers
    if not text:
        return (0, 0, -1, None, None, None, None, None, False, False, 0, 0.0, False)
    raw = text.encode("utf-8", "surrogatepass")
    words = _WORD.findall(text.lower())
    n = len(words)
    band = p.band(n)
    whole = len(plain.compress(raw)) / len(raw)
    starts = range(0, max(1, len(raw) - p.chunk_bytes // 2), p.chunk_bytes)
    ends = [*starts[1:], len(raw)]
    chunks = [len(plain.compress(raw[a:b])) / (b - a) for a, b in zip(starts, ends)] if len(starts) > 1 else [whole]
    count = repeated_words(words, p.run)
    share = count / n if n else 0.0
    if band < 0 or n < p.least_words:
        return (n, len(raw), band, whole, min(chunks), max(chunks), None, None, False, False, count, share, False)
    ratio, limit = _phrase_ratio(words, strong), p.limit(n)
    return (
        *(n, len(raw), band, whole, min(chunks), max(chunks), ratio, limit, min(chunks) < p.regular[band], max(chunks) > p.noisy[band]),
        *(count, share, ratio <= limit and count >= p.share * n - 1e-9),
    )


def compression_bands(df: DataFrame, keys: list[str], text: str, bands: Bands | None = None) -> DataFrame:
    """``keys`` and the measures of ``text``, a row for each row of ``df``; narrow, without a shuffle.

    ``too_regular`` and ``too_noisy`` are the verdicts of the text ratio over chunks by length band;
    ``repetitive`` says that at least ``share`` of the words are repeated. ``repeated_words`` and
    ``repeated_share`` are exact for every text; those of fewer words than ``least_words`` are never
    repetitive. NULL and empty texts have 0 words and no ratios.
    Repeated rows stay; columns other than ``keys`` are left out, and measures whose name is a key's get
    an underscore. A text is read whole, whatever its length.
    """
    p = bands or Bands()

    @F.pandas_udf(_SCHEMA)
    def measured(batches: pd.Series) -> pd.DataFrame:
        import zstandard

        packers = zstandard.ZstdCompressor(level=p.level), zstandard.ZstdCompressor(level=p.phrase_level)
        names = [x.split()[0] for x in _SCHEMA.split(",")]
        return pd.DataFrame([measure_text(t, p, packers) for t in batches], columns=names)

    out = df.select(*keys, measured(F.col(text).cast("string")).alias("__m"))
    names = [x.split()[0] for x in _SCHEMA.split(",")]
    return out.select(*keys, *[F.col(f"__m.{c}").alias(free_name(c, keys)) for c in names])
