"""Filling containers of fixed capacity: bounded-space online packing.

Each partition of the scan keeps a fixed number of open windows and places every item best-fit; if none
has room the fullest is emitted. The windows still open at the end of a partition (at most ``open_windows``
each) are merged over all partitions, in rounds over groups of bounded size. No text is shuffled: what moves are the windows'
sizes and the rows of the windows left over.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinemill.session import cut, free_name

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the byte-level vocabularies split a text before merging: fixed by the public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str = PATTERN):
    """The tokenizer of a rank file; once per Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(texts: list[str | None], path: str) -> list[int]:
    """Tokens of each text as a whole; lone surrogates count as the replacement character."""
    own = encoder(path)
    clean = ["" if t is None else t.encode("utf-8", "replace").decode() for t in texts]
    return [len(x) for x in own.encode_ordinary_batch(clean, num_threads=1)]


class OpenWindows:
    """At most ``most`` open windows of ``capacity``; ``place`` and ``rest`` return windows as (number, items)."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.room: list[tuple[int, int]] = []  # (room left, number), ascending
        self.items: dict[int, list] = {}
        self.made = 0

    def place(self, size: int, item) -> list[tuple[int, list]]:
        out, at = [], bisect_left(self.room, (size, -1))
        if at < len(self.room):
            room, number = self.room.pop(at)
        else:
            if len(self.room) >= self.most:
                number = self.room.pop(0)[1]  # the fullest
                out.append((number, self.items.pop(number)))
            room, number = self.capacity, self.made
            self.made += 1
            self.items[number] = []
        self.items[number].append(item)
        if room == size:
            out.append((number, self.items.pop(number)))
        else:
            insort(self.room, (room - size, number))
        return out

    def rest(self) -> list[tuple[int, list]]:
        return [(number, self.items[number]) for _, number in self.room]


def parts(n: int, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(number, first token, tokens) of the parts of an item of ``n`` tokens; one part unless n > capacity."""
    for number, start in enumerate(range(0, n, capacity)):
        yield number, start, min(capacity, n - start)


def pack_documents(
    df: DataFrame,
    key: str,
    text: str,
    *,
    capacity: int = 2048,
    open_windows: int = 32,
    tokenizer: str = TOKENIZER,
) -> DataFrame:
    """``key, part, first_token, n_tokens, n_parts, container``: where every text goes.

    A text of more than ``capacity`` tokens is split into full parts and one rest; every other text stays
    whole (``n_parts`` = 1). The parts in a container have at most ``capacity`` tokens together. NULL and
    empty texts have no tokens and no row. Repeated rows are items of their own; an equal key makes no
    difference. Columns other than ``key`` and ``text`` are left out, and result columns whose name is
    the key's get an underscore. An empty table gives no rows.
    """
    if capacity < 1 or open_windows < 1:
        raise ValueError("capacity and open_windows must be positive")
    key_type = df.schema[key].dataType
    placed = T.StructType(
        [T.StructField("k", key_type)]
        + [T.StructField(c, T.LongType()) for c in ("part", "first_token", "n_tokens", "n_parts", "task", "number")]
        + [T.StructField("left_over", T.BooleanType())]
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, windows = TaskContext.get().partitionId(), OpenWindows(capacity, open_windows)

        def rows(closed, left_over):
            found = [(*item, task, number, left_over) for number, items in closed for item in items]
            return pd.DataFrame(found, columns=placed.names)

        for batch in batches:
            closed = []
            for k, n in zip(batch["k"], token_counts(list(batch["x"]), tokenizer)):
                for number, start, size in parts(n, capacity):
                    closed += windows.place(size, (k, number, start, size, -(-n // capacity)))
            if closed:
                yield rows(closed, False)
        if rest := windows.rest():
            yield rows(rest, True)

    # Written once: a window's number must mean the same in both branches below.
    all_rows = cut(df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("x")).filter("length(x) > 0").mapInPandas(pack, placed))
    open_ends = all_rows.filter("left_over").groupBy("task", "number").agg(F.sum("n_tokens").alias("size"))
    merged = merge_windows(open_ends, ["task", "number"], "size", capacity)
    rest = all_rows.filter("left_over").join(merged, ["task", "number"])
    names = {"part": "part", "first_token": "first_token", "n_tokens": "n_tokens", "n_parts": "n_parts"}
    columns = [F.col("k").alias(key), *[F.col(c).alias(free_name(n, [key])) for c, n in names.items()]]
    container = free_name("container", [key])
    closed = all_rows.filter("not left_over").select(*columns, F.format_string("t%d-%d", "task", "number").alias(container))
    return closed.unionByName(rest.select(*columns, F.concat(F.lit("m"), "merged").alias(container)))


def merge_windows(windows: DataFrame, ids: list[str], size: str, capacity: int, most: int = 20_000) -> DataFrame:
    """``ids, merged``: which left-over windows go together; best-fit, largest first, by groups of about ``most`` windows.

    Each group leaves at most one container that is half empty or more. With several groups those containers are
    the windows of the next round, until one group is left; so no task gets more than about ``most`` windows.
    """
    schema = "w string, size long, box string"

    def merged(key: tuple, group: pd.DataFrame, turn: int) -> pd.DataFrame:
        group = group.sort_values(["size", "w"], ascending=[False, True])
        open_ones = OpenWindows(capacity, len(group) + 1)
        found = []
        for w, n in zip(group["w"], group["size"]):
            found += open_ones.place(int(n), (w, int(n)))
        found += open_ones.rest()
        return pd.DataFrame([(*item, f"{turn}/{key[0]}/{number}") for number, items in found for item in items], columns=["w", "size", "box"])

    def merge(turn: int):
        return lambda key, group: merged(key, group, turn)

    named = cut(windows.select(*ids, F.concat_ws("/", *[F.col(c).cast("string") for c in ids]).alias("w"), F.col(size).cast("long").alias("size")))
    now, placed, turn = named.select("w", "size"), None, 0
    while True:
        groups = max(1, -(-now.count() // most))
        dealt = now.withColumn("g", F.pmod(F.xxhash64("w"), F.lit(groups)))
        made = cut(dealt.groupBy("g").applyInPandas(merge(turn), schema))
        if placed is None:
            placed = made.select("w", "box")
        else:
            moved = made.select(F.col("w").alias("box"), F.col("box").alias("to"))
            placed = cut(placed.join(moved, "box", "left").select("w", F.coalesce("to", "box").alias("box")))
        if groups == 1:
            return named.join(placed, "w").select(*ids, F.col("box").alias("merged"))
        half = made.groupBy("box").agg(F.sum("size").alias("size")).filter(F.col("size") * 2 <= capacity)
        now, turn = cut(half.select(F.col("box").alias("w"), "size")), turn + 1


def container_fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row per container: its items, tokens and share of unused room."""
    return packed.groupBy("container").agg(
        F.count("*").alias("n_items"), F.sum("n_tokens").alias("tokens"), (1 - F.sum("n_tokens") / capacity).alias("unused")
    )
