"""P4 against brute force."""

import random

from lectern.llm import nearest_time

ERRORS = "error_id long, utt_id string, approx_time_s double, tick int, entity string"
PHONES = "utt_id string, phones array<struct<phone_id:long,xmin:double,xmax:double,canonical:string,perceived:string,err_type:string>>, lo int"


def brute(errors, phones, tolerance=0.15):
    spans = {}
    for utt, ps, *_ in phones:
        for p in ps or []:
            if p and utt is not None and p[1] is not None and p[2] is not None and p[1] == p[1] and p[2] == p[2] and (p[5] or "").strip().lower() in ("s", "d", "a"):
                spans.setdefault(utt.strip(" \t").lower(), set()).add((min(p[1], p[2]), max(p[1], p[2]), p[0]))
    out = {}
    for e, utt, t, *_ in errors:
        if e is None or utt is None or t is None or not t >= 0 or t == float("inf"):
            continue
        best = min(((max(0.0, lo - t, t - hi), -hi, lo, i) for lo, hi, i in spans.get(utt.strip(" \t").lower(), ())), default=None)
        if best and best[0] <= tolerance + 1e-9:
            out[e] = best[3]
    return out


def found(spark, errors, phones, **options):
    got = nearest_time.error_phone_pairs(spark.createDataFrame(errors, ERRORS), spark.createDataFrame(phones, PHONES), **options).collect()
    assert len(got) == len({r.error_id for r in got})
    return {r.error_id: r.phone_id for r in got}


def test_nearest(spark):
    r = random.Random(8)
    phones = [(f" U{u}\t", [(u * 100 + i, *r.sample([round(r.random() * 6, 3) for _ in range(4)] + [None], 2), "A", "B", r.choice(["s", " D", "a", "", None, "x"])) for i in range(r.randrange(25))], 1) for u in range(40)]
    phones += phones[:5] + [(None, [(9, 0.0, 1.0, "", "", "s")], 1), ("u1", None, 1), ("u2", [], 1)]
    errors = [(i, f"u{i % 45}", r.choice([round(r.random() * 6, 3)] * 6 + [None, float("nan"), -1.0, float("inf")]), 1, "") for i in range(1500)]
    errors += errors[:100] + [(None, "u1", 1.0, 1, ""), (9999, None, 1.0, 1, "")]
    want = brute(errors, phones)
    assert len(want) > 100
    for tick in (0.25, 0.01, 3.0):
        assert found(spark, errors, phones, tick=tick) == want


def test_edges_of_the_tolerance_and_ties(spark):
    phones = [("u", [(1, 1.0, 1.2, "", "", "s"), (2, 2.0, 1.9, "", "", "d"), (3, 5.0, 5.2, "", "", "a"), (4, 5.0, 5.2, "", "", "a")], 1)]
    errors = [(1, "u", 0.85, 1, ""), (2, "u", 0.849, 1, ""), (3, "u", 1.35, 1, ""), (4, "u", 2.15, 1, ""), (5, "u", 5.1, 1, ""), (6, "u", 0.0, 1, "")]
    assert found(spark, errors, phones) == {1: 1, 3: 1, 4: 2, 5: 3}


def test_a_crowded_tick_keeps_few_spans(spark):
    spans = spark.range(20_000).selectExpr("'u' AS entity", "id AS span_id", "1.0 + (id % 10) / 1000.0D AS lo", "1.1D AS hi")
    assert max(len(r.spans) for r in nearest_time.tick_candidates(spans, 0.15, 0.25).collect()) <= 12


def test_empty(spark):
    assert found(spark, [], []) == {}
    assert found(spark, [(1, "u", 1.0, 1, "")], []) == {}
