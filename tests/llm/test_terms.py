"""P1 against brute force, with heavy terms, heavy records and dirty rows."""

from collections import defaultdict

import pytest

from lectern.functions.words import joined_words_of
from lectern.llm import term_frequency

SCHEMA = "error_id long, utt_id string, ref_word string, hyp_word string, pattern_freq int, term string, n_rows int, kind int"


def brute(rows, fields):
    seen, count, who = set(), defaultdict(int), defaultdict(set)
    records = {r["utt_id"] for r in rows if r["utt_id"] is not None}
    for r in rows:
        key = (r["utt_id"], r["error_id"])
        if r["error_id"] is not None:
            if key in seen:
                continue
            seen.add(key)
        for f in fields:
            if r[f] is None or not (t := joined_words_of(str(r[f]))):
                continue
            count[f, t] += 1
            if r["utt_id"] is not None:
                who[f, t].add(r["utt_id"])
    mark = lambda k: "rare" if k < 3 else "common" if 100 * k > 2 * len(records) else None
    return {(f, t, n, len(who[f, t]), mark(len(who[f, t]))) for (f, t), n in count.items()}


def rows_of(n):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    out = []
    for i in range(n):
        utt = "hot" if i % 3 == 0 else None if i % 97 == 0 else f"u{i % 211}"
        ref = "The" if i % 3 == 1 else None if i % 13 == 0 else f"  w{i % 57}'s​ "
        hyp = "" if i % 17 == 0 else "..." if i % 19 == 0 else f"h {i % 400}"
        out.append(dict(zip(names, (None if i % 101 == 0 else i, utt, ref, hyp, i % 5 if i % 7 else None, "clash", 7, 1))))
    return out + out[:50]


def found(spark, rows, **options):
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    got = term_frequency.term_frequencies(df, ["ref_word", "hyp_word", "pattern_freq"], "utt_id", "error_id", **options)
    return sorted(map(tuple, got.collect()), key=str)


def test_counts_are_exact_whatever_is_heavy(spark):
    rows = rows_of(4000)
    want = sorted(brute(rows, ["ref_word", "hyp_word", "pattern_freq"]), key=str)
    assert found(spark, rows) == want
    assert found(spark, rows, max_heavy=1, record_salts=3) == want


def test_small_chunks_cut_at_records(spark, monkeypatch):
    rows = rows_of(900)
    want = sorted(brute(rows, ["ref_word", "hyp_word", "pattern_freq"]), key=str)
    monkeypatch.setattr(term_frequency, "CHUNK_ROWS", 7)
    assert found(spark, rows) == want


def test_empty_table_and_only_nulls(spark):
    assert found(spark, []) == []
    assert found(spark, [dict.fromkeys([x.split()[0] for x in SCHEMA.split(", ")])] * 3) == []


def test_very_long_values(spark):
    long = "x" * 200_000
    rows = [{"error_id": i, "utt_id": f"u{i}", "ref_word": long, "hyp_word": None, "pattern_freq": None, "term": "", "n_rows": 0, "kind": 0} for i in range(4)]
    assert found(spark, rows) == [("ref_word", long, 4, 4, "common")]


@pytest.mark.parametrize("hot", [True, False])
def test_a_row_delivered_again_with_other_values_is_one_row(spark, hot):
    """The earliest delivery counts, whether or not its record is heavy and wherever its deliveries land."""
    schema = "error_id long, utt_id string, ref_word string, logged_at int"
    rows = [(i, "one" if hot else f"u{i}", f"late{i % 7}", 2) for i in range(300)] + [(i, "one" if hot else f"u{i}", f"first{i % 5}", 1) for i in range(300)]
    rows += [(None, "one" if hot else None, "first0", 1)] * 4
    want = {(f"first{k}", 60 + 4 * (k == 0), 1 if hot else 60) for k in range(5)}
    for partitions in (1, 16):
        df = spark.createDataFrame(rows, schema).repartition(partitions)
        got = term_frequency.term_frequencies(df, ["ref_word"], "utt_id", "error_id", "logged_at", max_heavy=3, record_salts=16).collect()
        assert {(r.term, r.n_rows, r.n_records) for r in got} == want


def test_a_record_longer_than_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(term_frequency, "CHUNK_ROWS", 5)
    monkeypatch.setattr(term_frequency, "_detect", lambda rows, fields, top: ([["w1"]] * fields, []))
    rows = [{"error_id": i // 2, "utt_id": ["a", "b", None][i % 60 // 20], "ref_word": f"w{i % 4 // 2}", "hyp_word": "x", "pattern_freq": None, "term": "", "n_rows": 0, "kind": 0} for i in range(240)]
    assert found(spark, rows) == sorted(brute(rows, ["ref_word", "hyp_word", "pattern_freq"]), key=str)
