"""Most similar vectors for every vector, with randomly rotated one-bit codes.

Index: centroids are fitted on a bounded random sample; every vector goes to its ``probes`` nearest cells,
and two vectors meet if they share a cell. What is shuffled is a fixed record of 192 bytes a cell for
160 dimensions: the signs of the randomly rotated residual (packed bits), three correction scalars, and a
one-byte-per-dimension copy for reranking.

Search, inside a cell: inner products are estimated from the packed bits and the scalars; with the error
bound of the estimate, a vector is reranked only if its upper bound reaches the k-th best lower bound.

Size: there are at most ``most_cells`` cells; beyond that cells grow with the table, and one of more than ``tile``
records gets an index of its own inside its task, so that the work for a vector stays the same.

Skew: a cell that would exceed a task's memory is cut into tiles; values that fill more than a small part
of the sample (exact copies) are kept out of the cells but for their first ``k + 1`` members, since a
copy's nearest vectors are its copies.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinemill.session import cut


@dataclass(frozen=True)
class Index:
    """Parameters. ``sample`` bounds the rows that the centroids are fitted on (on the driver: 4 bytes a
    dimension each), ``cell`` is the mean number of vectors with a home in one cell, ``tile`` the most records that are
    all compared with one another; a cell of more is divided inside its task into parts of about ``part`` records,
    of which every record takes the ``part_probes`` nearest. ``task``: the most records in one task.
    ``error``: the width of the error bound in standard deviations."""

    probes: int = 6
    cell: int = 100
    most_cells: int = 8192
    sample: int = 24_576
    rounds: int = 6
    tile: int = 16_384
    part: int = 4096
    part_probes: int = 3
    task: int = 500_000
    error: float = 2.4
    #: A value with at least this share of the sample is held apart as a group of exact copies.
    heavy: float = 0.002
    seed: int = 7


def usable(vector: str, dims: int) -> Column:
    """``dims`` finite numbers, not all zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == dims) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """An Arrow list column (no NULLs, ``dims`` values each) as float32 rows of length one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def rotation(dims: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def centroids(x: np.ndarray, cells: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means; an empty cell keeps its old centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), cells, replace=False)].copy()
    for _ in range(rounds):
        home = np.concatenate([(x[i : i + 2048] @ centres.T).argmax(1) for i in range(0, len(x), 2048)])
        order = np.argsort(home, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(home[order]) > 0])
        sums = np.add.reduceat(x[order], starts, axis=0)
        lengths = np.linalg.norm(sums, axis=1)
        good = lengths > 0
        centres[home[order][starts][good]] = sums[good] / lengths[good, None]
    return centres


def nearest_cells(x: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    if probes >= len(centres):
        return np.tile(np.arange(len(centres)), (len(x), 1))
    return np.concatenate([np.argpartition(x[i : i + 2048] @ centres.T, -probes, axis=1)[:, -probes:] for i in range(0, len(x), 2048)])


def encode(x: np.ndarray, turned: np.ndarray, cells: np.ndarray, centres: np.ndarray, turned_centres: np.ndarray) -> np.ndarray:
    """The records of unit vectors ``x`` (``turned``: rotated) for one cell each."""
    dims = x.shape[1]
    rest = turned - turned_centres[cells]
    length = np.linalg.norm(rest, axis=1)
    signs = rest >= 0
    fit = np.abs(rest).sum(1) / (np.maximum(length, 1e-12) * np.sqrt(dims))  # <residual, its code>
    fit = np.where(length > 1e-6, fit, 1.0)
    scale = np.abs(turned).max(1) / 127
    scalars = np.stack(
        [
            length / (fit * np.sqrt(dims)),
            (turned * turned_centres[cells]).sum(1) - (centres[cells] ** 2).sum(1),
            length * np.sqrt(np.maximum(1 - fit**2, 0)) / (fit * np.sqrt(dims - 1)),
        ],
        axis=1,
    ).astype(np.float32)
    small = np.rint(turned / scale[:, None]).astype(np.int8)
    return np.concatenate([np.packbits(signs, axis=1), small.view(np.uint8), scalars.view(np.uint8)], axis=1)


def unpack(records: np.ndarray, dims: int) -> np.ndarray:
    """The unit vectors (rotated) of the records' byte copies."""
    packed = -(-dims // 8)
    full = records[:, packed : packed + dims].view(np.int8).astype(np.float32)
    return full / np.linalg.norm(full, axis=1, keepdims=True)


def search_in_parts(records: np.ndarray, ids: np.ndarray, own: np.ndarray, centre: np.ndarray, k: int, least: float, p: Index):
    """``search`` over a cell of any size: a large one by parts, in which near records meet; the best ``k`` of all of them."""
    if len(records) <= p.tile:
        return search(records, ids, own, centre, k, least, p.error)
    full = unpack(records, len(centre))
    parts = -(-len(records) * p.part_probes // p.part)
    some = full[np.random.default_rng(p.seed).choice(len(full), min(len(full), 8 * parts), replace=False)]
    near = nearest_cells(full, centroids(some, min(parts, len(some)), p.rounds, p.seed), p.part_probes)
    del full
    row, part = np.repeat(np.arange(len(records)), near.shape[1]), near.ravel()
    order = np.argsort(part, kind="stable")
    found = []
    for rows in np.split(row[order], np.flatnonzero(np.diff(part[order])) + 1):
        q, d, cosine = search(records[rows], ids[rows], own[rows], centre, k, least, p.error)
        found.append((rows[q], rows[d], cosine))
    q, d, cosine = (np.concatenate(x) for x in zip(*found))
    pair = np.lexsort((-cosine, d, q))
    q, d, cosine = q[pair], d[pair], cosine[pair]
    new = np.r_[True, (np.diff(q) != 0) | (np.diff(d) != 0)] if len(q) else np.empty(0, bool)
    q, d, cosine = q[new], d[new], cosine[new]
    order = np.lexsort((ids[d], -cosine, q))
    q, d, cosine = q[order], d[order], cosine[order]
    best = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[best], d[best], cosine[best]


def search(records: np.ndarray, ids: np.ndarray, own: np.ndarray, centre: np.ndarray, k: int, least: float, width: float, near: int = 32):
    """(query rows, found rows, cosines): the ``k`` best of the ``own`` rows for every row, by reranked cosine.

    One product of the queries with the scaled signs gives the upper bound of every inner product, error included. Some
    vectors with the largest bounds are reranked first: their ``k``-th best cosine is a floor, and only what may
    reach it is reranked.
    """
    dims = len(centre)
    packed = -(-dims // 8)
    scalars = records[:, packed + dims :].copy().view(np.float32)
    full = unpack(records, dims)
    _, first = np.unique(ids[own], return_index=True)
    data = np.flatnonzero(own)[first]
    _, queries = np.unique(ids, return_index=True)
    n = len(data)
    if not n:
        return queries[:0], queries[:0], np.empty(0, np.float32)
    a, g, e = (scalars[data, i] for i in range(3))
    bits = np.unpackbits(records[data, :packed], axis=1, count=dims).astype(np.float32) * 2 - 1
    # Columns: scaled signs, the vector's own term, 1 for the query's, the width of the error.
    codes = np.ascontiguousarray(np.concatenate([bits * a[:, None], g[:, None], np.ones((n, 1), np.float32), e[:, None]], axis=1).T)
    del bits
    target = full[data]
    groups = max(k, min(4 * k, n // near)) if n > 8 * k * near else 0
    at = np.minimum(np.searchsorted(ids[data], ids[queries]), n - 1)  # the data are in the order of their ids
    itself = np.where(ids[data][at] == ids[queries], at, -1)
    out = []
    for start in range(0, len(queries), 512):
        q, me = queries[start : start + 512], itself[start : start + 512]
        rest = full[q] - centre
        most = np.concatenate([rest, np.ones((len(q), 1), np.float32), (full[q] @ centre)[:, None], width * np.linalg.norm(rest, axis=1)[:, None]], axis=1) @ codes
        most[np.flatnonzero(me >= 0), me[me >= 0]] = -9.0
        floor = np.full(len(q), least, dtype=np.float32)
        if groups:
            # The best of the columns r, r + n / near, ...: a few such winners are nearly the best of all.
            wide = n // near
            best = most[:, : wide * near].reshape(len(q), near, wide).max(axis=1)
            won = np.argpartition(best, wide - groups, axis=1)[:, wide - groups :]
            stacked = most[:, : wide * near].reshape(len(q), near, wide)
            row = np.arange(len(q))[:, None]
            column = stacked[row, :, won].argmax(axis=2) * wide + won
            cosine = np.einsum("ijk,ik->ij", target[column], full[q])
            floor = np.maximum(floor, np.partition(cosine, groups - k, axis=1)[:, groups - k] - 1e-6)
        rows, columns = np.divmod(np.flatnonzero(most >= floor[:, None]), n)
        there = most[rows, columns] > -8
        rows, columns = rows[there], columns[there]
        if len(rows) > 0.1 * most.size:  # one product is quicker than so many single cosines
            cosine = (full[q] @ target.T)[rows, columns]
        else:
            cosine = np.concatenate([np.einsum("ij,ij->i", full[q[rows[i : i + 65536]]], target[columns[i : i + 65536]]) for i in range(0, len(rows), 65536)] or [np.empty(0, np.float32)])
        keep = cosine >= np.maximum(floor, least)[rows] - 1e-6
        keep &= cosine >= least
        rows, columns, cosine = rows[keep], columns[keep], cosine[keep]
        order = np.lexsort((columns, -cosine, rows))
        rows, columns, cosine = rows[order], columns[order], cosine[order]
        top = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        out.append((q[rows[top]], data[columns[top]], cosine[top]))
    return tuple(np.concatenate(x) for x in zip(*out))


def nearest(df: DataFrame, keys: list[str], vector: str, *, dims: int = 160, k: int = 5, least: float = -1.0, index: Index | None = None) -> DataFrame:
    """``q: struct<keys>, n: struct<keys>, cosine``: about the ``k`` most similar vectors of every vector.

    ``cosine`` comes from the one-byte copies (error about 0.001). Neighbours below ``least`` are left out,
    which saves their reranking. Rows that repeat ``keys`` count once. Vectors that are NULL, of another
    length, all zero or hold NULL, NaN or infinite values are neither queries nor found. Equal cosines
    follow a hash of the keys. With fewer than ``k`` other vectors there are fewer rows; an empty table
    gives none. Other columns are ignored.
    """
    p = index or Index()
    spark = df.sparkSession
    key_type = T.StructType([T.StructField(c, df.schema[c].dataType) for c in keys])
    base = df.filter(usable(vector, dims)).select(F.struct(*keys).alias("key"), F.xxhash64(*keys).alias("id"), F.col(vector).cast("array<float>").alias("v"))
    rows = base.count()

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in matrix(b.column("v"), dims)], pa.binary())], ["v"])

    fraction = min(1.0, p.sample / max(rows, 1))
    picked = base.select("v").sample(fraction, seed=p.seed).mapInArrow(raw, "v binary").limit(2 * p.sample).collect()
    if rows and not picked:  # chance may leave a small sample empty
        picked = base.select("v").limit(p.sample).mapInArrow(raw, "v binary").collect()
    counts, size = Counter(r.v for r in picked), len(picked)
    del picked
    values = np.frombuffer(b"".join(counts), dtype=np.float32).reshape(-1, dims)
    if not size:  # no usable vector
        return spark.createDataFrame([], T.StructType([T.StructField("q", key_type), T.StructField("n", key_type), T.StructField("cosine", T.FloatType())]))
    n = rows
    heavy = {v for v, times in counts.items() if times >= max(4 * k, p.heavy * size)}
    del counts
    cells = int(min(max(1, round(n / p.cell)), p.most_cells, len(values)))
    centres = centroids(values, cells, p.rounds, p.seed) if cells > 1 else np.zeros((1, dims), np.float32)
    turn = rotation(dims, p.seed)
    load = np.bincount(nearest_cells(values, centres, p.probes).ravel(), minlength=cells) * (n / size)
    tiles = np.maximum(1, np.ceil(load / p.task)).astype(np.int64)
    shared = spark.sparkContext.broadcast((centres, turn, centres @ turn, tiles, heavy))

    record = T.StructType(
        [T.StructField("cell", T.IntegerType()), T.StructField("tile", T.IntegerType()), T.StructField("own", T.BooleanType())]
        + [T.StructField("key", key_type), T.StructField("id", T.LongType()), T.StructField("record", T.BinaryType())]
    )

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, turn, turned_centres, tiles, _ = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("v"), dims)
            near, turned, ids = nearest_cells(x, centres, p.probes), x @ turn, b.column("id").to_numpy()
            for j in range(near.shape[1]):
                cell = near[:, j]
                made, times = encode(x, turned, cell, centres, turned_centres), tiles[cell]
                at = np.repeat(np.arange(len(x)), times)
                tile = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                blob = pa.Array.from_buffers(
                    pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * made.shape[1]).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(made).tobytes())]
                )
                take = pa.array(at)
                own = tile == (ids[at] % tiles[cell[at]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell[at].astype(np.int32)), pa.array(tile.astype(np.int32)), pa.array(own), b.column("key").take(take), pa.array(ids[at]), blob.take(take)], ["cell", "tile", "own", "key", "id", "record"]
                )

    found = T.StructType([T.StructField("q", key_type), T.StructField("n", key_type), T.StructField("cosine", T.FloatType())])

    def in_cell(group: pa.Table) -> pa.Table:
        centre = shared.value[2][group.column("cell")[0].as_py()]
        blob = group.column("record").combine_chunks()
        records = np.frombuffer(b"".join(blob.to_pylist()), dtype=np.uint8).reshape(group.num_rows, -1)
        q, d, cosine = search_in_parts(records, group.column("id").to_numpy(), group.column("own").to_numpy(zero_copy_only=False), centre, k, least, p)
        key = group.column("key").combine_chunks()
        return pa.table([key.take(pa.array(q)), key.take(pa.array(d)), pa.array(cosine, pa.float32())], names=["q", "n", "cosine"])

    apart = None
    if heavy:

        def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = [r.tobytes() for r in matrix(b.column("v"), dims)]
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("id"), pa.array([v if v in shared.value[4] else None for v in x], pa.binary())], ["key", "id", "same"])

        marks = T.StructType([T.StructField("key", key_type), T.StructField("id", T.LongType()), T.StructField("same", T.BinaryType())])
        copies = base.mapInArrow(marked, marks).filter("same is not null").select("key", F.xxhash64("same").alias("same")).distinct()
        first = Window.partitionBy("same").orderBy("key")
        kept = cut(copies.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1))
        apart = copies.join(kept.select("same", F.col("key").alias("n"), "place"), "same").filter((F.col("place") <= k))
        apart = apart.join(kept.select(F.col("key").alias("kept")), F.col("key") == F.col("kept"), "left_anti")
        apart = apart.select(F.col("key").alias("q"), "n", F.lit(1.0).cast("float").alias("cosine"))
        others = copies.join(kept.select(F.col("key").alias("kept")), F.col("key") == F.col("kept"), "left_anti").select("key")
        base = base.join(others, "key", "left_anti")

    met = base.mapInArrow(to_cells, record).groupBy("cell", "tile").applyInArrow(in_cell, found)
    met = met.groupBy("q", "n").agg(F.max("cosine").alias("cosine"))
    best = Window.partitionBy("q").orderBy(F.desc("cosine"), F.xxhash64("n"), "n")
    met = met.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).drop("place")
    return met if apart is None else met.unionByName(apart.filter(F.lit(1.0) >= least))


def exact_cosines(pairs: DataFrame, df: DataFrame, keys: list[str], vector: str, *, dims: int = 160, most_broadcast: int = 500_000) -> DataFrame:
    """``pairs`` (q, n) with ``cosine`` computed from the vectors themselves, in double precision.

    Only vectors that occur in a pair are moved; their keys are broadcast if there are at most
    ``most_broadcast`` of them, and joined by a shuffle otherwise.
    """
    wanted = cut(pairs.select(F.explode(F.array("q", "n")).alias("key")).distinct())
    few = wanted.count() <= most_broadcast
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = df.filter(usable(vector, dims)).select(F.struct(*keys).alias("key"), v.alias("v"))
    rows = rows.join(F.broadcast(wanted) if few else wanted, "key", "left_semi").groupBy("key").agg(F.first("v").alias("v"))
    unit = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.withColumn("unit", unit)
    out = pairs.select("q", "n").join(rows.select(F.col("key").alias("q"), F.col("v").alias("a"), F.col("unit").alias("ua")), "q")
    out = out.join(rows.select(F.col("key").alias("n"), F.col("v").alias("b"), F.col("unit").alias("ub")), "n")
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return out.select("q", "n", (dot / (F.col("ua") * F.col("ub"))).alias("cosine"))
