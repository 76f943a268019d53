"""Filling fixed-capacity containers (problem 7).

Shortest-pack-first over the length histogram: lengths are placed longest
first, each onto the open packing pattern with the most room that takes it,
and only the *counts* of patterns are updated, so the work depends on the
capacity and not on the number of items. The patterns are then joined back to
the items by their rank within their length.

``fit="fullest"`` places onto the fullest pattern that fits instead; on the
corpora measured so far both reach the least possible number of containers.

Size bounds: the histogram has at most ``capacity`` rows. A placing step ends a
length or uses a pattern up, and only the step that ends a length leaves an
additional pattern, so there are at most 2 x capacity patterns; each names at
most sqrt(2 x capacity) different lengths. That table is broadcast.

Defined results: items of size 0 (empty or null) are in no container; an item
above the capacity is cut into full pieces and one remainder; no other item is
split; repeated doc_ids are separate items only if the rows differ in
``piece_no``, so doc_id must be unique as it is in the table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.runtime import materialise, number_in_groups

CAPACITY = 1024


def pack_histogram(histogram: dict[int, int], capacity: int, *, emptiest_first: bool = True) -> list[tuple[int, tuple]]:
    """[(how often, ((length, multiplicity), ...)), ...] that holds every item."""
    open_by_room: dict[int, list[tuple[int, tuple]]] = defaultdict(list)
    done: list[tuple[int, tuple]] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        fits = sorted((room for room, patterns in open_by_room.items() if patterns and room >= length), reverse=emptiest_first)
        for room in fits:
            patterns = open_by_room[room]
            while patterns and left:
                often, parts = patterns.pop()
                repeat = room // length
                if left < repeat:
                    full, repeat = 1, left
                else:
                    full = min(often, left // repeat)
                if full < often:
                    patterns.append((often - full, parts))
                left -= full * repeat
                _put(open_by_room, done, full, (*parts, (length, repeat)), room - length * repeat)
            if not left:
                break
        per = capacity // length
        if left >= per:
            _put(open_by_room, done, left // per, ((length, per),), capacity - per * length)
        if left % per:
            _put(open_by_room, done, 1, ((length, left % per),), capacity - (left % per) * length)
    return done + [p for patterns in open_by_room.values() for p in patterns]


def _put(open_by_room: dict, done: list, often: int, parts: tuple, room: int) -> None:
    (open_by_room[room] if room else done).append((often, parts))


def choose_patterns(histogram: dict[int, int], capacity: int, fit: str) -> list[tuple[int, tuple]]:
    if fit not in ("shortest", "fullest"):
        raise ValueError(f"unknown fit: {fit}")
    return pack_histogram(histogram, capacity, emptiest_first=fit == "shortest")


def _intervals(patterns: list[tuple[int, tuple]]) -> np.ndarray:
    """Rows (length, first rank, containers, first container, offset in container), sorted."""
    next_rank: dict[int, int] = defaultdict(int)
    rows, container = [], 0
    for often, parts in patterns:
        offset = 0
        for length, repeat in parts:
            rows.append((length, next_rank[length], often, container, offset))
            next_rank[length] += often * repeat
            offset += length * repeat
        container += often
    rows.sort()
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


def fill_containers(sizes: DataFrame, *, capacity: int = CAPACITY, fit: str = "shortest") -> DataFrame:
    """``sizes`` (doc_id, n_tokens) -> doc_id, piece_no, token_start, n_tokens, container_id, offset."""
    spark = sizes.sparkSession
    cuts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / capacity))
    pieces = sizes.where("n_tokens > 0").select("doc_id", "n_tokens", F.explode(cuts).alias("piece_no"))
    start = F.col("piece_no") * capacity
    pieces = pieces.select("doc_id", "piece_no", start.alias("token_start"), F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - start).alias("n_tokens"))
    pieces = materialise(pieces)
    histogram = {r["n_tokens"]: r["n"] for r in pieces.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    table = _intervals(choose_patterns(histogram, capacity, fit))
    bound = spark.sparkContext.broadcast(table)
    ranked = number_in_groups(pieces, ["n_tokens"], ["doc_id", "piece_no"], "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = bound.value
        keys = t[:, 0] << 42 | t[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_tokens", "rank"))
            row = t[np.searchsorted(keys, length << 42 | rank, side="right") - 1]
            into = rank - row[:, 1]
            slot, which = np.divmod(into, np.maximum(row[:, 2], 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("piece_no"), batch.column("token_start"), batch.column("n_tokens"), pa.array(row[:, 3] + which), pa.array(row[:, 4] + slot * length)],
                names=["doc_id", "piece_no", "token_start", "n_tokens", "container_id", "offset"],
            )

    return ranked.mapInArrow(place, "doc_id bigint, piece_no bigint, token_start bigint, n_tokens bigint, container_id bigint, offset bigint")


def container_report(placed: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, unused share, and the least number that any packing needs."""
    per = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("items"))
    return per.agg(
        F.count(F.lit(1)).alias("containers"),
        F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"),
        F.coalesce(F.ceil(F.sum("used") / capacity), F.lit(0)).alias("least_containers"),
        F.coalesce(F.max("used"), F.lit(0)).alias("fullest"),
        F.coalesce(F.max("items"), F.lit(0)).alias("most_items"),
        (1 - F.coalesce(F.try_divide(F.sum("used"), F.count(F.lit(1)) * capacity), F.lit(1.0))).alias("unused_share"),
    )
