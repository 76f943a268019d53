"""Splitting oversized items at natural boundaries (problem 5).

A content above 80 lines or 16,000 characters is cut by dynamic programming over
its boundary positions: f(b) is the least cost of pieces that end at b, and a
piece costs the penalty of cutting at its end (none before a definition at the
outer level, most inside an indented or bracketed stretch) plus its squared
deviation from an even size. Consecutive pieces share 12 lines; only where the
limits do not allow that fewer are shared, down to none.

Pieces are exact slices: without the shared lines they concatenate to the
content. Lines end at LF (CR LF included); a final line end opens no further
line; characters are code points. A line above the character limit is cut inside,
behind a separator where there is one near the even cut.

Defined results: null, empty and small contents have no pieces; a chunk delivered
twice is cut once (rows of one chunk_id with different contents are each cut);
start_line counts from the chunk's start_line, or from 1 where that is null or
below 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.runtime import spread

MAX_LINES, MAX_CHARS, OVERLAP = 80, 16_000, 12
#: Fixed value: what counts as a token of a chunk.
TOKEN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*|\d+|[一-鿿]+")
#: Cost of each shared line that is missing, and weight of the deviation from an even size.
MISSING_LINE, IMBALANCE = 5.0, 2.0
_DEFINITION = re.compile(r"\s*(?:@|(?:export|default|public|private|protected|static|async|abstract|final)\s+|def\s|class\s|function\b|func\s|interface\s|type\s|const\s+\w+\s*=\s*(?:async\s*)?\(|create\s|insert\s|select\s|#+\s|\[)", re.I)
_CONTINUED = re.compile(r"(?:[,({\[+\-*/%=&|?:\\.]|\b(?:and|or|not|in|return))\s*$")
_SEPARATORS = ("\n", ";", "}", ",", " ", "\t", "")


def lines_of(content: str) -> list[str]:
    """The lines with their ends."""
    lines = content.split("\n")
    out = [line + "\n" for line in lines[:-1]]
    return out + [lines[-1]] if lines[-1] else out


def cut_long(line: str, limit: int) -> list[str]:
    """A line above the limit in near-even parts that end behind a separator where possible."""
    parts = -(-len(line) // limit)
    out, at = [], 0
    while len(line) - at > limit:
        want = at + min(limit, -(-(len(line) - at) // parts))
        low, high = max(at + 1, want - (limit >> 3)), min(at + limit, want + (limit >> 3))
        for separator in _SEPARATORS:
            left = line.rfind(separator, low, high) + len(separator) if separator else want
            if left > low and left <= high:
                break
        out.append(line[at:left])
        at, parts = left, max(1, parts - 1)
    return [*out, line[at:]]


def penalties(units: list[str]) -> np.ndarray:
    """Cost of a cut before unit i, for i = 0..n."""
    n = len(units)
    cost = np.zeros(n + 1)
    depths = [len(u) - len(u.lstrip(" \t")) if u.strip() else -1 for u in units]
    follow = n
    after = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        if depths[i] >= 0:
            follow = depths[i]
        after[i] = 0 if follow == n else follow
    for i in range(1, n):
        if not units[i - 1].endswith("\n"):
            cost[i] = 6.0  # inside a line
            continue
        blank = depths[i - 1] < 0
        steps = min(after[i] / 4, 4)
        c = 0.6 * steps + (0.0 if blank else 0.8)
        if _DEFINITION.match(units[i]):
            c -= 0.5
        if depths[i] < 0:
            c += 0.3  # the blank line belongs to what precedes it
        if not blank and _CONTINUED.search(units[i - 1]):
            c += 1.5
        if depths[i] > depths[i - 1] >= 0:
            c += 1.0  # a body and its head
        cost[i] = max(0.0, c)
    return cost


def plan(content: str, *, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int, int, int, int]]:
    """Pieces as (start offset, end offset, first line, last line, shared lines), lines from 0."""
    units: list[str] = []
    line_no: list[int] = []
    for i, line in enumerate(lines_of(content)):
        for part in cut_long(line, max_chars) if len(line) > max_chars else (line,):
            units.append(part)
            line_no.append(i)
    n = len(units)
    if not n:
        return []
    chars = np.zeros(n + 1, dtype=np.int64)
    np.cumsum([len(u) for u in units], out=chars[1:])
    line = np.array(line_no)
    # Shared lines are whole lines: a cut inside a line shares none.
    whole = np.array([i == 0 or units[i - 1].endswith("\n") for i in range(n)])
    cost = penalties(units)
    step = max(1, max_lines - overlap)
    pieces = max(1, -(-max(1, n - overlap) // step), -(-int(chars[n]) // max_chars))
    even = (n + overlap * (pieces - 1)) / pieces
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    back = np.full(n + 1, -1, dtype=np.int64)
    shared = np.zeros(n + 1, dtype=np.int64)
    for b in range(1, n + 1):
        # Earliest p for which [p, b) is within both limits.
        low = max(int(np.searchsorted(chars, chars[b] - max_chars, side="left")), int(np.searchsorted(line, line[b - 1] - max_lines + 1, side="left")))
        p = np.arange(low, b)
        want = np.where(p == 0, 0, np.minimum(overlap, p))
        start = np.maximum(p - want, low)  # the limits of this piece hold with the shared lines
        inside = (p > 0) & ~whole[p]
        start = np.where(inside, p, start)
        missing = np.where(inside, 0, want - (p - start))
        total = best[p] + cost[b] * (b < n) + IMBALANCE * ((b - start) / even - 1) ** 2 + MISSING_LINE * missing
        k = int(np.argmin(total))
        best[b], back[b], shared[b] = total[k], p[k], p[k] - start[k]
    out, b = [], n
    while b > 0:
        p = int(back[b])
        start = p - int(shared[b])
        out.append((int(chars[start]), int(chars[b]), int(line[start]), int(line[b - 1]), int(shared[b])))
        b = p
    return out[::-1]


_DDL = "chunk_id bigint, piece_no int, start_line int, end_line int, token_count int, n_lines int, n_chars int, shared_lines int, content string"


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["chunk_id", "piece_no", "start_line", "end_line", "token_count", "n_lines", "n_chars", "shared_lines", "content"]
    kinds = [pa.int64(), *[pa.int32()] * 7, pa.string()]
    for batch in batches:
        rows: list[list] = [[] for _ in names]
        for chunk_id, first, content in zip(*[batch.column(n).to_pylist() for n in ("chunk_id", "start_line", "content")]):
            base = first if first is not None and first > 0 else 1
            for k, (start, end, top, bottom, shared) in enumerate(plan(content)):
                text = content[start:end]
                values = (chunk_id, k, base + top, base + bottom, sum(1 for _ in TOKEN.finditer(text)), bottom - top + 1, len(text), shared, text)
                for into, x in zip(rows, values):
                    into.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], names=names)


def oversized(chunks: DataFrame, *, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS) -> DataFrame:
    """The rows whose content is above a limit, found without leaving the JVM."""
    content = F.col("content")
    ends = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    n_lines = ends + F.when(content.endswith("\n") | (content == ""), 0).otherwise(1)
    rows = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("start_line").cast("int").alias("start_line"), F.col("content").cast("string").alias("content"))
    return rows.where((n_lines > max_lines) | (F.length(content) > max_chars))


def split_chunks(chunks: DataFrame) -> DataFrame:
    """chunk_id, piece_no, start_line, end_line, token_count, n_lines, n_chars, shared_lines, content of every piece."""
    rows = oversized(chunks).groupBy("chunk_id", "content").agg(F.min("start_line").alias("start_line"))
    return spread(rows, "chunk_id").mapInArrow(_split, _DDL)


def oversized_chunks(pieces: DataFrame) -> DataFrame:
    """chunk_id of every chunk that was cut."""
    return pieces.where("piece_no > 0").select("chunk_id").distinct()
