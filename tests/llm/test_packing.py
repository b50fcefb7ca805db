"""P6: invariants of every packing, and how little is unused."""

import os

import pytest

from lectern.llm import packing

pytestmark = pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="no public tokenizer")
SCHEMA = "doc_id long, text string, window int, piece string"


def check(spark, rows, **options):
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), **options).collect()
    capacity = options.get("capacity", 2048)
    count = packing.token_counter(packing.vocabulary(packing.TOKENIZER))
    windows, docs = {}, {}
    for r in got:
        windows.setdefault(r.window, []).append(r)
        docs.setdefault(r.doc_id, []).append((r.piece, r.piece_start, r.n_tokens))
    for pieces in windows.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.window_start):
            assert r.window_start == at and r.fill <= capacity
            at += r.n_tokens
        assert at == pieces[0].fill
    sizes = {}
    for doc, text, *_ in rows:
        if doc is not None and text:
            sizes.setdefault(doc, []).append(count(text))
    assert set(docs) == {d for d, s in sizes.items() if sum(s)}
    for doc, pieces in docs.items():
        assert sum(n for *_, n in pieces) == sum(sizes[doc])
        if len(sizes[doc]) == 1:
            at = 0
            for k, (piece, start, n) in enumerate(sorted(pieces)):
                assert (piece, start) == (k, at) and (n == capacity or k == len(pieces) - 1)
                at += n
    return windows


def test_small_and_large_documents(spark):
    rows = [(i, "word " * (1 + i * 37 % 190), 1, "x") for i in range(400)] + [(1000, "many words here " * 900, 1, "x"), (1001, None, 1, "x"), (1002, "", 1, "x"), (None, "abc", 1, "x")]
    rows += [(5, "again", 1, "x")]
    w = check(spark, rows, capacity=256, open_windows=8)
    offline = packing.OpenWindows(256, 10**9)  # best fit decreasing over all items at once
    full = sum(offline.add(r.n_tokens, r) is not None for r in sorted((r for p in w.values() for r in p), key=lambda r: -r.n_tokens))
    assert len(w) <= 1.08 * (full + len(offline.rest()))


def test_merging_in_several_levels(spark):
    rows = [(i, "token " * (i % 50 + 1), 1, "") for i in range(600)]
    check(spark, rows, capacity=64, open_windows=16, merge_windows=10)


def test_open_windows_are_bounded_and_best_fit():
    w = packing.OpenWindows(10, 2)
    assert w.add(6, "a") is None and w.add(5, "b") is None
    assert w.add(4, "c") == (10, ["a", "c"])  # fills a, not b
    assert w.add(9, "d") is None
    assert w.add(8, "e") == (9, ["d"])  # none fits: the fullest goes
    assert sorted(w.rest()) == [(5, ["b"]), (8, ["e"])]


def test_one_very_long_word_and_empty_table(spark):
    check(spark, [(1, "a" * 60_000, 1, ""), (2, "é" * 3000, 1, "")], capacity=128)
    assert check(spark, []) == {}
