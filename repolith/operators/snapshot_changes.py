"""What changed between full snapshots (problem 1).

Every delivery is read once in Arrow batches: the payload is parsed strictly and
each item of a section becomes ``(section, key, digest)``, where the digest is
taken over a canonical form (fields sorted, nulls dropped, numbers by value).
All the rest is relational:

* deliveries of one snapshot collapse to one row, and a project's snapshots are
  numbered 1..n by (created_at, snapshot_id) without gathering a project in one
  task (``number_in_groups``);
* gaps and islands over (project, section, key): runs of consecutive snapshot
  numbers with one digest form validity intervals;
* an interval that starts after snapshot 1 is an addition, or a change if the
  key's previous interval ends right before it; an interval that ends before
  snapshot n with no interval starting right after it is a removal at the next
  snapshot.

Defined results: a payload that is null or not strict JSON (NaN, trailing text
and cut-off texts included) does not exist; valid JSON without the lists, or
with something else in their place, is a readable snapshot without items; items
that are no objects or whose ``key`` is no string are left out; of two items
with one key the last counts; rows without project_id or snapshot_id are left
out; a null created_at sorts first; of a snapshot delivered with several
created_at the earliest counts, of several texts at one time the one whose
content digest is smallest. An empty table gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolith.runtime import materialise, number_in_groups, shared_table, spread

#: section name -> where its list is found in a payload
SECTIONS = {"finding": ("quality", "findings"), "parse_issue": ("parse_issues",), "cycle": ("dependency", "cycles")}

_ITEMS = pa.list_(pa.struct([("section", pa.string()), ("item_key", pa.string()), ("digest", pa.int64())]))
_OUT = pa.schema(
    [("project_id", pa.int64()), ("snapshot_id", pa.int64()), ("created_at", pa.timestamp("us", "UTC")), ("content", pa.int64()), ("items", _ITEMS)]
)
_DDL = "project_id bigint, snapshot_id bigint, created_at timestamp, content bigint, items array<struct<section:string,item_key:string,digest:bigint>>"


def _reject(token: str):
    raise ValueError(token)


def canonical(value) -> str:
    """One text per value: equal exactly if two JSON values count as equal."""
    kind = type(value)
    if kind is str:
        return json.dumps(value)
    if kind is int:
        return str(value)
    if kind is Decimal:
        return _number(value)
    if kind is dict:
        return "{" + ",".join(f"{json.dumps(k)}:{canonical(value[k])}" for k in sorted(value) if value[k] is not None) + "}"
    if kind is list:
        return "[" + ",".join([canonical(x) for x in value]) + "]"
    return "null" if value is None else "true" if value else "false"


def _number(value: Decimal) -> str:
    sign, digits, exponent = value.as_tuple()
    text = "".join(map(str, digits)).lstrip("0")
    short = text.rstrip("0")
    if not short:
        return "0"
    exponent += len(text) - len(short)
    if 0 <= exponent <= 400:
        short, exponent = short + "0" * exponent, 0
    return ("-" if sign else "") + short + (f"e{exponent}" if exponent else "")


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def read_items(text: str | None) -> tuple[int, list[tuple[str, str, int]]] | None:
    """(digest of the whole content, items) of a payload; None if it is unreadable."""
    if text is None:
        return None
    try:
        payload = json.loads(text, parse_float=Decimal, parse_constant=_reject)
        items: dict[tuple[str, str], int] = {}
        for section, path in SECTIONS.items():
            node = payload
            for step in path:
                node = node.get(step) if isinstance(node, dict) else None
            for item in node if isinstance(node, list) else ():
                if isinstance(item, dict) and isinstance(item.get("key"), str):
                    items[section, item["key"]] = _digest(canonical(item))
    except (ValueError, RecursionError):
        return None
    rows = sorted((s, k, d) for (s, k), d in items.items())
    return _digest(repr(rows)), rows


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, content, items = [], [], []
        for i, text in enumerate(batch.column("data_json").to_pylist()):
            found = read_items(text)
            if found is not None:
                keep.append(i)
                content.append(found[0])
                items.append([{"section": s, "item_key": k.encode("utf-8", "replace").decode(), "digest": d} for s, k, d in found[1]])
        part = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [part.column("project_id"), part.column("snapshot_id"), part.column("created_at").cast(_OUT.field("created_at").type), pa.array(content, pa.int64()), pa.array(items, _ITEMS)],
            schema=_OUT,
        )


def readable_snapshots(snapshots: DataFrame) -> DataFrame:
    """Every readable delivery: project_id, snapshot_id, created_at, content, items."""
    raw = snapshots.select(
        F.col("project_id").cast("long"), F.col("snapshot_id").cast("long"), F.col("created_at").cast("timestamp"), F.col("data_json").cast("string")
    ).where("project_id is not null and snapshot_id is not null and data_json is not null")
    return spread(raw, "snapshot_id").mapInArrow(_parse, _DDL)


def numbered_snapshots(readable: DataFrame) -> DataFrame:
    """One row per snapshot: project_id, snapshot_id, created_at, content (of the delivery that counts), seq (from 1)."""
    first = F.min(F.struct("created_at", "content")).alias("first")
    once = readable.groupBy("project_id", "snapshot_id").agg(first).select("project_id", "snapshot_id", "first.created_at", "first.content")
    numbered = number_in_groups(once, ["project_id"], [F.col("created_at").asc_nulls_first(), F.col("snapshot_id")], "n")
    return numbered.withColumn("seq", F.col("n") + 1).drop("n")


def validity_intervals(readable: DataFrame, numbered: DataFrame) -> DataFrame:
    """Gaps and islands: project_id, section, item_key, digest, from_seq, to_seq."""
    keys = ["project_id", "snapshot_id", "content"]
    states = readable.join(numbered.select(*keys, "seq"), keys).select("project_id", "seq", F.explode("items").alias("i"))
    # Deliveries of one snapshot with one content hold the same items.
    states = states.select("project_id", "seq", "i.section", "i.item_key", "i.digest")
    line = Window.partitionBy("project_id", "section", "item_key").orderBy("seq")
    gap = F.col("seq") - F.lag("seq").over(line)
    breaks = (gap > 1) | (F.col("digest") != F.lag("digest").over(line))
    islands = states.withColumn("island", F.sum(F.coalesce(breaks, F.lit(True)).cast("int")).over(line))
    return islands.groupBy("project_id", "section", "item_key", "island").agg(
        F.first("digest").alias("digest"), F.min("seq").alias("from_seq"), F.max("seq").alias("to_seq")
    )


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """project_id, snapshot_id, section, item_key, change_kind; see the module text."""
    readable = shared_table(readable_snapshots(snapshots))
    numbered = materialise(numbered_snapshots(readable))
    line = Window.partitionBy("project_id", "section", "item_key").orderBy("from_seq")
    spans = validity_intervals(readable, numbered).select(
        "*", F.lag("to_seq").over(line).alias("prev_to"), F.lead("from_seq").over(line).alias("next_from")
    )
    starts = F.when(F.col("from_seq") > 1, F.struct(F.col("from_seq").alias("seq"), F.when(F.col("prev_to") == F.col("from_seq") - 1, "changed").otherwise("added").alias("change_kind")))
    ends = F.when(F.coalesce(F.col("next_from") != F.col("to_seq") + 1, F.lit(True)), F.struct((F.col("to_seq") + 1).alias("seq"), F.lit("removed").alias("change_kind")))
    events = spans.select("project_id", "section", "item_key", F.explode(F.array(starts, ends)).alias("e")).where("e is not null")
    events = events.select("project_id", "section", "item_key", F.col("e.seq").alias("seq"), F.col("e.change_kind").alias("change_kind"))
    # A removal after the last snapshot has no later snapshot to join with and so drops out.
    names = numbered.select("project_id", "seq", "snapshot_id")
    return events.join(names, ["project_id", "seq"]).select("project_id", "snapshot_id", "section", "item_key", "change_kind")


def change_totals(snapshots: DataFrame) -> DataFrame:
    """Rows per project, section and kind of change."""
    return snapshot_changes(snapshots).groupBy("project_id", "section", "change_kind").agg(F.count(F.lit(1)).alias("changes"))
