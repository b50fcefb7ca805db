"""P2 against brute force."""

import random

import numpy as np
import pytest

from lectern.functions.distance import align
from lectern.functions.words import words_of
from lectern.llm import split_overlap

SCHEMA = "utt_id string, dataset string, text string, split string, loaded_at int, id long, n int, words string"


def brute(rows, percent=15, least=6):
    first = {}
    for r in rows:
        if r[0] is not None and (r[0] not in first or r[4] < first[r[0]][4]):
            first[r[0]] = r
    of = [(r[0], split_overlap.SPLITS.get((r[3] or "").strip().lower()), words_of(r[2])) for r in first.values() if r[2] is not None]
    of = [x for x in of if x[1] and len(x[2]) >= least]
    out = set()
    for i, s, a in of:
        for j, t, b in of:
            if s != "train" and t == "train" and abs(len(a) - len(b)) * 100 <= percent * max(len(a), len(b)):
                d = len(align(a, b))
                if 100 * d <= percent * max(len(a), len(b)):
                    out.add((i, j, d))
    return out


def make(seed, n=160, vocabulary=9):
    r = random.Random(seed)
    rows, texts = [], []
    for i in range(n):
        if texts and r.random() < 0.6:
            ws = list(r.choice(texts))
            for _ in range(r.randint(0, 4)):
                at = r.randrange(len(ws) + 1)
                ws[at : at + r.randint(0, 1)] = [f"w{r.randrange(vocabulary)}"] * r.randint(0, 1)
        else:
            ws = [f"w{r.randrange(vocabulary)}" for _ in range(r.choice([1, 5, 6, 7, 8, 12, 13, 14, 20, 27, 33]))]
        texts.append(ws)
        rows.append((f"u{i}", "ds", r.choice(["  ", " ", ", "]).join(ws).title(), r.choice(["train", "TRAIN ", "dev", "Test", "validation", None, "other"]), 1, i, 3, "clash"))
    return rows


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r.eval_id, r.train_id, r.distance) for r in split_overlap.split_overlaps(df, **options).collect()}


def test_all_pairs_and_no_other(spark):
    for seed in (1, 2):
        rows = make(seed)
        assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("least", [1, 3])
def test_hot_segments_of_either_side_are_cut(spark, monkeypatch, least):
    rows = make(3)
    monkeypatch.setattr(split_overlap, "LEAST_HOT", least)
    assert found(spark, rows) == brute(rows)


def test_a_full_bitmap_loses_nothing(spark):
    rows = make(5)
    assert found(spark, rows, max_bits=1) == brute(rows)


def test_banded_distances():
    r = random.Random(6)
    for longest in (3, 9, 40):
        a, b = ([np.array([r.randrange(4) for _ in range(r.randint(1, longest))], np.int32) for _ in range(300)] for _ in "ab")
        b = [x if r.random() < 0.5 else np.concatenate((x[:1], x[2:], y[:1])) for x, y in zip(a, b)]
        most = np.array([r.randint(0, 5) for _ in a])
        for x, y, m, d in zip(a, b, most, split_overlap.banded_distances(a, b, most)):
            want = len(align(list(x), list(y)))
            assert d == want if want <= m else d > m


def test_nulls_repeats_long_texts_and_empty_tables(spark):
    long = " ".join(f"w{i}" for i in range(900))
    near = long.replace("w500 ", "")
    rows = [
        (None, "a", "one two three four five six", "train", 1, 1, 1, ""), ("n", "a", None, "train", 1, 1, 1, ""), ("e", "a", "", "test", 1, 1, 1, ""),
        ("x", "a", "One two, three four five six!", "test", 1, 1, 1, ""), ("x", "a", "one two three four five six", "test", 2, 1, 1, ""),
        ("y", None, "one two three four five six", "train", 1, 1, 1, ""), ("l", "a", long, "dev", 1, 1, 1, ""), ("m", "a", near, "train", 1, 1, 1, ""),
    ]
    assert found(spark, rows) == {("x", "y", 0), ("l", "m", 1)}
    assert found(spark, []) == set()
