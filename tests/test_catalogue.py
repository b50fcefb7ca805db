"""Every query against its SQL, on the smallest test tables, with the plans that are shipped."""

import pytest

from conftest import same_as_sql
from lectern.plans.catalogue import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_and_sql_agree(spark, data, name):
    same_as_sql(spark, data, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, data, name):
    assert QUERIES[name](spark, data).count()


def test_alignments_and_word_times(spark, data):
    """Every error row against a plain trace of the same pair."""
    from lectern.functions.distance import align
    from lectern.plans.base import top_pairs

    rows = {}
    for r in sorted(QUERIES["aligned_error_rows"](spark, data).collect(), key=lambda r: (r.hyp_id, r.align_pos)):
        rows.setdefault(r.hyp_id, []).append(r)
    for p in top_pairs(spark, data).collect():
        mine = rows.get(p.hyp_id, [])
        assert [(r.op, r.ref_word, r.hyp_word, r.ref_idx, r.hyp_idx) for r in mine] == (align(p.ref, p.hyp) if p.ref else [])
        last = 0.0
        for r in mine:
            assert r.time_s >= last or r.hyp_idx is None and r.time_s == last
            last = r.time_s
