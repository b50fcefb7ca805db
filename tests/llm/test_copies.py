"""P5 against a dictionary of canonical forms."""

import random
import re

from lectern.functions.words import words_of
from lectern.llm import format_duplicates

SCHEMA = "hyp_id long, text string, id int, form string, bucket string"


def brute(rows, least=6):
    first, out = {}, set()
    for i, t, *_ in sorted({r[:2] for r in rows if r[0] is not None and r[1] is not None}):
        if len(words_of(t)) < least:
            continue
        key = tuple(sorted(x for f in re.split("[|;]", t) if (x := " ".join(words_of(f))))) if "=" in t else " ".join(words_of(t))
        out.add((first.setdefault(key, i), i))
    return out


def found(spark, rows, **options):
    got = [tuple(r) for r in format_duplicates.copies(spark.createDataFrame(rows, SCHEMA), "hyp_id", "text", **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


def make(n):
    r = random.Random(4)
    rows = []
    for i in range(n):
        ws = [f"w{r.randrange(3)}" for _ in range(r.choice([5, 6, 6, 7, 9]))]
        kind = r.random()
        if kind < 0.3:
            text = "the one text that a third of all rows hold"
        elif kind < 0.6:
            fields = [f"k{j} = {w}" for j, w in enumerate(ws)]
            r.shuffle(fields)
            text = r.choice(["|", " ; "]).join(fields)
        else:
            text = r.choice([" ", "  ", " ", "-"]).join(ws)
        rows.append((i, r.choice([str.upper, str.lower, str.title])(text) + r.choice(["", "!", "﻿", " ."]), 1, "f", "b"))
    return rows + rows[: n // 10] + [(None, "a b c d e f", 1, "", ""), (n, None, 1, "", ""), (n + 1, "", 1, "", ""), (n + 2, "===|||;;;", 1, "", "")]


def test_groups_at_every_bucket_size(spark):
    rows = make(700)
    want = brute(rows)
    for bucket_rows, step in ((50_000, 4), (20, 4), (3, 1), (1, 3)):
        assert found(spark, rows, bucket_rows=bucket_rows, step=step) == want


def test_fields_and_plain_texts_differ(spark):
    rows = [(1, "a=b c d|e=f g", 1, "", ""), (2, "E=F g;A=b C d|", 1, "", ""), (3, "a b c d e f g", 1, "", ""), (4, "a=b|c d e=f g", 1, "", ""), (5, "x=1|x=1|y=2", 1, "", ""), (6, "x=1|y=2|y=2", 1, "", "")]
    assert {g for g in found(spark, rows) if g[0] != g[1]} == {(1, 2)}


def test_forms_that_begin_with_each_other_and_long_texts(spark):
    a, b = "one two three four five six", "one two three four five six seven"
    long = "word " * 60_000
    rows = [(i, t, 1, "", "") for i, t in enumerate([a, b, a.upper(), b + ".", a, long, long.strip() + "!"])]
    assert found(spark, rows, bucket_rows=1, step=4) == brute(rows)


def test_a_long_common_prefix_costs_no_further_level(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(format_duplicates, "stored", lambda df, name, f=format_duplicates.stored: tables.append(name) or f(df, name))
    counts = []
    for prefix in ("a b c d e f ", "key=value pairs that an exporter repeats " * 10):
        rows = [(i, f"{prefix} {i % 40} tail{i % 7}", 1, "", "") for i in range(600)]
        assert found(spark, rows, bucket_rows=100) == brute(rows)
        counts.append(len(tables))
        tables.clear()
    assert counts[0] == counts[1]


def test_a_form_that_holds_most_rows(spark):
    """Its rows are dealt over many tries, which all know its first id."""
    rows = [(i, "The one text, that most rows hold!" if i % 5 else f"some other text of number {i}", 1, "", "") for i in range(500)]
    rows += rows[:40]
    for bucket_rows in (7, 50_000):
        assert found(spark, rows, bucket_rows=bucket_rows) == brute(rows)


def test_empty(spark):
    assert found(spark, []) == set()
