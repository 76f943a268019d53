"""Problem 1 against brute force, and its defined results for dirty input."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta, timezone

import pytest

from repolith.operators.snapshot_changes import canonical, read_items, snapshot_changes

DDL = "snapshot_id long, project_id long, label string, reason string, created_at timestamp, data_json string, key string, seq int"
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def body(findings=(), issues=(), cycles=()):
    return {"quality": {"findings": list(findings)}, "parse_issues": list(issues), "dependency": {"cycles": list(cycles)}}


def frame(spark, rows):
    return spark.createDataFrame([(s, p, "", "", t, j, "clash", 7) for s, p, t, j in rows], DDL)


def brute(rows):
    by = {}
    for s, p, t, j in rows:
        if s is None or p is None:
            continue
        items = read_items(j)
        if items is not None:
            old = by.setdefault(p, {}).get(s)
            if old is None or t < old[0]:
                by[p][s] = (t, {(a, k): d for a, k, d in items[1]})
    out = []
    for p, snaps in by.items():
        line = sorted(snaps.items(), key=lambda x: (x[1][0], x[0]))
        for (_, (_, a)), (s, (_, b)) in zip(line, line[1:]):
            out += [(p, s, *k, "added") for k in b.keys() - a.keys()] + [(p, s, *k, "removed") for k in a.keys() - b.keys()]
            out += [(p, s, *k, "changed") for k in a.keys() & b.keys() if a[k] != b[k]]
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for n in range(160):
        items = [{"key": f"k{i}", "metric": rng.choice([1, 1.0, 2, None]), "x": rng.choice(["a", "b"])} for i in range(6) if rng.random() < 0.6]
        text = json.dumps(body(items, items[:2], [{"key": "c", "paths": ["a", "b"]}] * rng.randint(0, 2)), indent=rng.choice([None, 2]))
        if rng.random() < 0.1:
            text = rng.choice([None, "", text[:-3], "NaN"])
        rows.append((n % 120, rng.choice([1, 1, 1, 2, 3]) if n < 120 else None, T0 + timedelta(hours=rng.randint(0, 40)), text))
    rows = [r for r in rows if r[1] is not None]
    rows += [(s, p, t, json.dumps(json.loads(j), sort_keys=True)) for s, p, t, j in rows[:20] if read_items(j)]
    got = sorted(tuple(r) for r in snapshot_changes(frame(spark, rows)).collect())
    assert got == brute(rows) and got


@pytest.mark.parametrize("a,b,same", [("1", "1.0", True), ("100", "1e2", True), ("1", '"1"', False), ("true", "1", False), ('{"a":1,"b":null}', '{"a":1.0}', True), ("[1,2]", "[2,1]", False), ("-0.0", "0", True), ("0.10", "0.1", True)])
def test_values_compare_as_values(a, b, same):
    from decimal import Decimal

    left, right = (canonical(json.loads(x, parse_float=Decimal)) for x in (a, b))
    assert (left == right) is same


def test_unreadable_payloads_and_odd_items():
    assert read_items(None) is None and read_items("") is None and read_items('{"a":1} x') is None and read_items('{"a":NaN}') is None
    assert read_items("[" * 100_000) is None
    assert read_items("3")[1] == [] and read_items('{"quality": 4}')[1] == []
    assert read_items(json.dumps(body([{"key": 5}, "x", {"key": "a", "m": 1}, {"key": "a", "m": 2}])))[1] == read_items(json.dumps(body([{"key": "a", "m": 2}])))[1]


def test_empty_table(spark):
    assert snapshot_changes(frame(spark, [])).count() == 0


def test_all_of_one_project(spark):
    """A project that holds every row is numbered over several tasks."""
    rows = [(n, 9, T0 + timedelta(minutes=n), json.dumps(body([{"key": "a", "m": n // 2}]))) for n in range(200)]
    got = snapshot_changes(frame(spark, rows)).collect()
    assert len(got) == 99 and {r.change_kind for r in got} == {"changed"}
