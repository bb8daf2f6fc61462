"""Evaluation texts leaking into training text, by winnowing.

The hashes of all runs of ``k`` words are taken and the smallest of every ``window`` consecutive ones is
kept; a span of ``k + window - 1`` words that two texts share puts an equal fingerprint into both. With
k = 4 and window = 2 that is every shared run of five words, so nothing that the five-word measure counts
escapes. In a document with a common fingerprint the hits are then extended: its five-word sequences are held
against those of the items, and those that follow one another in both texts make a run, the shared span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinemill.session import cut, free_name

_WORD = re.compile(r"[^\W_]+")
#: Odd multipliers of the polynomial word hash.
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Winnow:
    """Parameters. ``most_broadcast``: with at most so many test sequences and fingerprints (8 bytes each) they are
    sent to every worker; more of them are joined by a shuffle instead."""

    k: int = 4
    window: int = 2
    length: int = 5
    share: float = 0.25
    most_broadcast: int = 1_000_000

    def __post_init__(self):
        if self.k + self.window - 1 > self.length:
            raise ValueError("a shared sequence could escape: k + window - 1 must not exceed length")


class Hasher:
    """64-bit hashes of words, remembered per worker up to a fixed number of words."""

    def __init__(self, most: int = 200_000):
        self.known: dict[str, int] = {}
        self.most = most

    def words(self, text: str | None) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        known, found = self.known, _WORD.findall(text.lower()) if text else []
        if len(known) > self.most:
            known.clear()
        out = [known.get(w) or known.setdefault(w, xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))) for w in found]
        return np.array(out, dtype=np.uint64)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = (out ^ words[i : i + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out * _STEP


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """The smallest hash of every ``window`` consecutive ones (of all, if there are fewer)."""
    if len(hashes) <= window:
        return hashes.min(keepdims=True) if len(hashes) else hashes
    n = len(hashes) - window + 1
    low = hashes[:n]
    for i in range(1, window):
        low = np.minimum(low, hashes[i : i + n])
    return np.unique(low)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sequences(df: DataFrame, key: str, text: str, p: Winnow, *, prints: bool, only=None) -> DataFrame:
    """``key, h, at``: distinct fingerprints (``prints``), or every sequence of ``length`` words with its place, of every row.

    ``only``: a broadcast pair of sorted arrays (fingerprints, sequences). Then a text without one of the
    fingerprints gives nothing, and of the others come the sequences among those given, with their place.
    """
    schema = T.StructType([T.StructField("k", df.schema[key].dataType), T.StructField("h", T.LongType()), T.StructField("at", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for batch in batches:
            keys, hashes, places = [], [], []
            for k, text_ in zip(batch["k"], batch["x"]):
                words = hasher.words(text_)
                if prints or only is not None:
                    marks = winnow(grams(words, p.k), p.window)
                if only is not None and not _within(marks, only.value[0]).any():
                    continue
                if prints and only is None:
                    h, at = marks, np.zeros(len(marks), dtype=np.int64)
                else:
                    h = grams(words, p.length)
                    at = np.arange(len(h))
                    if only is not None:
                        keep = _within(h, only.value[1])
                        h, at = h[keep], at[keep]
                keys += [k] * len(h)
                hashes.append(_signed(h))
                places.append(at)
            if keys:
                yield pd.DataFrame({"k": pd.Series(keys, dtype=batch["k"].dtype), "h": np.concatenate(hashes), "at": np.concatenate(places)})

    source = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("x")).filter("k is not null and length(x) > 0")
    return source.mapInPandas(run, schema)


def _within(values: np.ndarray, sorted_ones: np.ndarray) -> np.ndarray:
    if not len(sorted_ones):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_ones, values), len(sorted_ones) - 1)
    return sorted_ones[at] == values


def leaked_items(corpus: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, params: Winnow | None = None) -> DataFrame:
    """``doc, item, shared, sequences, share, spans, first_word, last_word``: which documents give away which items.

    ``share`` is the part of the item's distinct ``length``-word sequences that stand in the document; a row
    comes for a share of at least ``params.share``. ``spans`` counts the runs of words that both have in the same order,
    each as long as it goes; ``first_word`` and ``last_word`` (from 0) bound the longest of them in the document, the
    first of the longest. Words are runs of letters and digits of the lower-cased text.

    Items of fewer than ``length`` words have no sequence and can't leak; NULL and empty texts give nothing,
    NULL keys neither. Repeated rows count once (texts under one key count together). Other columns are
    left out; if both keys have one name the item's gets an underscore, as do result columns.
    """
    p = params or Winnow()
    spark = corpus.sparkSession
    tests = cut(sequences(items, item, item_text, p, prints=False).select(F.col("k").alias("item"), "h", F.col("at").alias("place")).distinct())
    size = tests.groupBy("item").agg(F.countDistinct("h").alias("n"))
    marks = cut(sequences(items, item, item_text, p, prints=True).select("h").distinct())
    wanted = cut(tests.select("h").distinct())
    if wanted.count() + marks.count() <= p.most_broadcast:
        arrays = [np.sort(np.array(x.toPandas()["h"], dtype=np.int64).view(np.uint64)) for x in (marks, wanted)]
        found = sequences(corpus, doc, text, p, prints=False, only=spark.sparkContext.broadcast(arrays))
    else:
        # Documents with a common fingerprint first, then the sequences of those alone.
        hit = sequences(corpus, doc, text, p, prints=True).join(marks, "h", "left_semi").select(F.col("k").alias(doc)).distinct()
        found = sequences(corpus.join(hit, doc, "left_semi"), doc, text, p, prints=False).join(wanted, "h", "left_semi")
    met = cut(found.select(F.col("k").alias("doc"), "h", "at").distinct().join(tests, "h"))
    shared = met.groupBy("doc", "item").agg(F.countDistinct("h").alias("shared")).join(size, "item")
    pairs = shared.filter(F.col("shared") >= F.col("n") * p.share - 1e-9)
    # A run stays on one diagonal: the place in the document less that in the item.
    line = Window.partitionBy("doc", "item", "line").orderBy("at")
    on = met.join(pairs.select("doc", "item"), ["doc", "item"], "left_semi").select("doc", "item", "at", (F.col("at") - F.col("place")).alias("line"))
    runs = on.withColumn("run", F.col("at") - F.row_number().over(line)).groupBy("doc", "item", "line", "run").agg(F.min("at").alias("a"), F.max("at").alias("b"))
    runs = runs.groupBy("doc", "item").agg(F.count("*").alias("spans"), F.max(F.struct((F.col("b") - F.col("a")).alias("len"), (-F.col("a")).alias("a"))).alias("r"))
    pairs = pairs.join(runs.select("doc", "item", "spans", (-F.col("r.a")).alias("a"), (F.col("r.len") - F.col("r.a")).alias("b")), ["doc", "item"])
    taken = [doc, free_name(item, [doc])]
    return pairs.select(
        F.col("doc").alias(taken[0]),
        F.col("item").alias(taken[1]),
        F.col("shared").alias(free_name("shared", taken)),
        F.col("n").alias(free_name("sequences", taken)),
        (F.col("shared") / F.col("n")).alias(free_name("share", taken)),
        F.col("spans").alias(free_name("spans", taken)),
        F.col("a").alias(free_name("first_word", taken)),
        (F.col("b") + p.length - 1).alias(free_name("last_word", taken)),
    )
