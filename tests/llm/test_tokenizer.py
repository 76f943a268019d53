"""Segment-tree BPE against the public library, and packing against its bounds."""

from __future__ import annotations

import base64

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from repolith.llm import packing, tokenizer

RANKS = tokenizer.load_ranks()
OURS = tokenizer.SegmentTreeBPE(RANKS)
THEIRS = tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.mark.parametrize("text", ["", "a", "Hello world", "<|endoftext|> x", "naïve — 数据库 🎉", " \n\t  x", "'re 've it's", "=" * 5000, "ab" * 999, "\u0000\u200b", "x" * 3 + "\r\n" * 40])
def test_same_ids(text):
    assert OURS.encode(text) == THEIRS.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=200))
def test_same_ids_on_random_text(text):
    assert OURS.encode(text) == THEIRS.encode_ordinary(text)


def test_every_token_of_the_vocabulary_merges_to_itself():
    assert all(OURS.merge(token) == [rank] for token, rank in RANKS.items())


def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (3, "hi", "z")], "doc_id long, text string, ids string")
    assert {r.doc_id: r.ids for r in tokenizer.token_ids(df).collect()} == {1: [], 2: [], 3: THEIRS.encode_ordinary("hi")}
    assert {r.doc_id: r.n_tokens for r in tokenizer.token_counts(df).collect()} == {1: 0, 2: 0, 3: 1}
    assert tokenizer.token_ids(df.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), min_size=1, max_size=12), st.sampled_from(["shortest", "fullest"]))
def test_patterns_hold_every_item(histogram, fit):
    patterns = packing.choose_patterns(histogram, 32, fit)
    placed: dict[int, int] = {}
    for often, parts in patterns:
        assert often > 0 and sum(length * n for length, n in parts) <= 32
        for length, n in parts:
            placed[length] = placed.get(length, 0) + often * n
    assert placed == histogram


def test_containers(spark):
    sizes = [(i, (i * 37) % 50) for i in range(400)] + [(900, 1025), (901, 3000), (902, 1024), (903, 0)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens long")
    rows = packing.fill_containers(df).collect()
    used: dict[int, list] = {}
    docs: dict[int, list] = {}
    for r in rows:
        used.setdefault(r.container_id, []).append((r.offset, r.offset + r.n_tokens))
        docs.setdefault(r.doc_id, []).append((r.token_start, r.n_tokens))
    for spans in used.values():
        spans.sort()
        assert spans[-1][1] <= 1024 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    for doc, n in sizes:
        pieces = sorted(docs.get(doc, []))
        assert sum(p[1] for p in pieces) == n and (len(pieces) <= 1 or n > 1024)
        assert all(a[0] + a[1] == b[0] for a, b in zip(pieces, pieces[1:]))
    report = packing.container_report(packing.fill_containers(df)).first()
    assert report.containers == len(used) <= report.least_containers + 1
    assert packing.fill_containers(df.where("n_tokens = 0")).count() == 0


def test_ids_do_not_depend_on_the_cache():
    fresh = tokenizer.SegmentTreeBPE(RANKS)
    text = "def load_queue(self): return self.queue " * 3
    assert fresh.encode(text) == fresh.encode(text) == THEIRS.encode_ordinary(text)
    assert base64.b64encode(b"a")
