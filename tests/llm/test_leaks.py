"""P7 against brute force over shingles."""

import random

from lectern.functions.words import words_of
from lectern.llm import passage_leaks
from lectern.storage import stored

DOCS, ITEMS = "doc_id long, text string, item_id int, term string, positions string", "item_id long, text string, part int"


def brute(docs, items, run=12):
    of = lambda t: {tuple(w[i : i + run]) for w in [words_of(t)] for i in range(len(w) - run + 1)}
    items = [(i, of(t)) for i, t, *_ in items if i is not None and t is not None]
    return {(d, i) for d, t, *_ in docs if d is not None and t is not None for i, s in items if of(t) & s}


def index(spark, docs):
    return stored(passage_leaks.positional_index(spark.createDataFrame(docs, DOCS)), "index")


def found(spark, docs, items, **options):
    got = passage_leaks.phrase_matches(index(spark, docs), spark.createDataFrame(items, ITEMS), **options).collect()
    texts = {}
    for d, t, *_ in docs:
        texts.setdefault(d, []).append(words_of(t or ""))
    for r in got:  # every reported run is there
        assert any([w[r.doc_start : r.doc_start + r.n_words] == words_of(x)[r.item_start : r.item_start + r.n_words] for i, x, *_ in items if i == r.item_id and x for w in texts[r.doc_id]])
    return {(r.doc_id, r.item_id) for r in got}


def make(seed, vocabulary=5):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(vocabulary)}"
    items = [(i, " ".join(word() for _ in range(r.randint(8, 40))), 1) for i in range(12)]
    docs = []
    for d in range(60):
        ws = [word() if r.random() < 0.9 else "zz" for _ in range(r.randint(0, 60))]
        w = words_of(r.choice(items)[1])
        a = r.randrange(len(w))
        ws[len(ws) // 2 : len(ws) // 2] = w[a : a + r.randint(9, 16)]
        docs.append((d, r.choice([" ", ", ", "\n"]).join(ws).upper(), 1, "t", "p"))
    return docs, items


def test_all_leaks_and_no_other(spark):
    for seed in (1, 2):
        docs, items = make(seed)
        want = brute(docs, items)
        assert want
        assert found(spark, docs, items) == want
    assert found(spark, docs, items, block_words=60, probes=1) == want


def test_dirty_rows(spark):
    text = " ".join(f"a{i}" for i in range(30))
    items = [(1, text, 1), (1, text, 1), (None, text, 1), (2, None, 1), (3, "", 1), (4, "too short", 1)]
    docs = [(1, text * 2, 1, "", ""), (1, text, 1, "", ""), (None, text, 1, "", ""), (2, None, 1, "", ""), (3, "", 1, "", ""), (4, "x " * 100_000 + text, 1, "", ""), (5, " ".join(text.split()[:11]), 1, "", "")]
    assert found(spark, docs, items) == {(1, 1), (4, 1)}


def test_proximity(spark):
    text = " ".join(f"a{i}" for i in range(30))
    docs = [(1, text.replace("a7 ", "b ").replace("a15 ", "b c "), 1, "", ""), (2, "b " * 50, 1, "", ""), (3, text, 1, "", "")]
    got = passage_leaks.proximity_matches(index(spark, docs), spark.createDataFrame([(1, text, 1)], ITEMS)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (3, 1)}


def test_empty(spark):
    docs, items = make(1)
    assert found(spark, [], items) == set() and found(spark, docs, []) == set()
    assert found(spark, docs, [(1, "only three words", 1)]) == set()


def near(spark, docs, items, **options):
    return {(r.doc_id, r.item_id) for r in passage_leaks.proximity_matches(index(spark, docs), spark.createDataFrame(items, ITEMS), **options).collect()}


def test_proximity_of_parts_and_of_edited_passages(spark):
    a = [f"a{i}" for i in range(137)]
    edited = [x for i, w in enumerate(a) for x in ([w, f"zz{i}"] if i % 5 == 4 else [w])]  # no six words without a foreign one
    texts = [a[70:], a[125:], a[40:52], edited, edited[90:130], ["zz"] * 5000 + a[100:112], a[100:105], a[::9]]
    docs = [(d, " ".join(ws), 1, "", "") for d, ws in enumerate(texts)]
    assert near(spark, docs, [(1, " ".join(a), 1)]) == {(d, 1) for d in range(6)}


def test_phrase_matches_are_proximity_matches(spark):
    for seed in (1, 2):
        docs, items = make(seed, 40)
        assert brute(docs, items) and brute(docs, items) <= near(spark, docs, items)


def test_proximity_finds_all_windows(spark):
    r = random.Random(3)
    items = [(i, " ".join(f"w{r.randrange(300)}" for _ in range(40)), 1) for i in range(6)]
    docs = []
    for d in range(40):
        w = words_of(r.choice(items)[1])
        a, n = r.randrange(20), r.randint(10, 24)
        part = [x if r.random() < 0.8 else "zz" for x in w[a : a + n]]
        docs.append((d, " ".join(["zz"] * r.randint(0, 3000) + part), 1, "", ""))

    def same_places(d, i):  # brute force at one offset
        return any(sum(x == y for x, y in zip(d[o : o + 24], i[s : s + 24])) >= 12 for s in range(17) for o in range(len(d)))

    want = {(d, i) for d, t, *_ in docs for i, x, _ in items if same_places(["-"] * 24 + words_of(t), words_of(x))}
    assert want and want <= near(spark, docs, items)


def test_one_index_serves_many_searches_and_segments(spark, monkeypatch):
    monkeypatch.setattr(passage_leaks, "SEGMENT_TOKENS", 90)
    docs, items = make(7)
    of = index(spark, docs)
    for part in (items[:6], items[6:], items):
        got = passage_leaks.phrase_matches(of, spark.createDataFrame(part, ITEMS)).collect()
        assert {(r.doc_id, r.item_id) for r in got} == brute(docs, part)


def test_few_segments_of_the_stored_index_are_held_at_once(spark, monkeypatch, tmp_path):
    import pyarrow.parquet as pq

    from lectern.llm import queries

    monkeypatch.setattr(passage_leaks, "SEGMENT_TOKENS", 90)
    docs, _ = make(7)
    spark.createDataFrame(docs, DOCS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in queries._index(spark, str(tmp_path)).inputFiles()]
    sizes = [m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)]
    assert sum(sizes) > 12 and max(sizes) <= 4
