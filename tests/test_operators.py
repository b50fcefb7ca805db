import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.operators import corpus, errors, ngram, rescoring, sampling
from lectern.operators.spans import nearest_span


def test_categories(spark):
    cases = [
        ("substitute", "em", "them", "", False, False, "reference_error"), ("insert", None, "uh", "", False, True, "reference_error"), ("substitute", "five", "5", "", False, False, "normalization"), ("substitute", "colour", "color", "", False, False, "normalization"),
        ("substitute", "there", "their", "", False, False, "normalization"), ("delete", "cat", None, "", True, False, "accent_phoneme"), ("insert", None, "the", "a [the] b", False, False, "disfluency"), ("insert", None, "the", "", False, False, "hallucination"),
        ("substitute", "cat", "dog", "", False, False, "model_lexical"), ("delete", "cat", None, "", False, False, "deletion_other"), ("x", None, None, None, False, False, "other"),
    ]
    df = spark.createDataFrame(cases, "op string, r string, h string, c string, co boolean, tr boolean, want string")
    for r in df.select("want", errors.classify(*[F.col(c) for c in ("op", "r", "h", "c", "co", "tr")]).alias("got")).collect():
        assert r.got == r.want


def test_agreement_of_known_counts(spark):
    rows = [(True, True)] * 45 + [(True, False)] * 36 + [(False, False)] * 56 + [(False, True)] * 70
    r = spark.createDataFrame(rows, "p boolean, t boolean").agg(*errors.agreement(F.col("p"), F.col("t"))).first()
    assert (r.tp, r.fp, r.tn, r.fn, r.agreement, r.precision, r.recall, r.f1, r.kappa) == (45, 36, 56, 70, 0.488, 0.556, 0.391, 0.459, 0.0)
    assert spark.createDataFrame([], "p boolean, t boolean").agg(*errors.agreement(F.col("p"), F.col("t"))).first().kappa == 0.0


def test_patterns_and_time(spark):
    e = spark.createDataFrame([(1, "u", "delete", "a", None, None), (2, "u", "delete", "a", None, 1.5), (3, "u", "insert", None, "b", None)], "error_id int, utt string, op string, ref_word string, hyp_word string, t double")
    assert {r.error_id: r.n for r in errors.with_pattern_frequency(e).collect()} == {1: 2, 2: 2, 3: 1}
    assert [r.time_s for r in errors.with_error_time(e, ["utt"], ["error_id"], "t").orderBy("error_id").collect()] == [0.0, 1.5, 1.5]
    assert [(r.n, round(r.covered, 3)) for r in errors.coverage(errors.pattern_frequency(e)).orderBy(F.desc("n")).collect()] == [(2, 0.667), (1, 1.0)]


def test_nearest_span(spark):
    df = spark.createDataFrame([(0.86, [(1.0, 1.2), (1.0, 1.2)]), (0.5, [(1.0, 1.2), (0.1, 0.2)]), (1.0, [])], "t double, s array<struct<xmin:double,xmax:double>>")
    got = [r[0] for r in df.select(nearest_span(F.col("t"), F.col("s"), 0.15)).collect()]
    assert (got[0].d, got[0].i) == (0.0, 0) and (round(got[1].d, 6), got[1].i) == (0.3, 1) and got[2] is None


def test_provenance_precedence(spark):
    rows = [(0, "a", 0, "Held out"), (0, "b", 0, "x"), (0, "c", 0, "Keep this!"), (1, "d", 0, "keep THIS"), (1, "e", 0, "held, out")]
    c, ev = spark.createDataFrame(rows, "src int, id string, sent_pos int, sentence string"), spark.createDataFrame([("held out",)], "sentence string")
    assert [r.id for r in corpus.kept(c, ev, "src", ["id", "sent_pos"]).collect()] == ["c"]
    assert Counter({r.bucket: r.n for r in corpus.provenance(c, ev, "src").groupBy("bucket").sum("n").withColumnRenamed("sum(n)", "n").collect()}) == Counter(leakage=2, too_short=1, kept=1, duplicate=1)
    with pytest.raises(ValueError):
        corpus.assert_leakage_free(c, spark.createDataFrame([("KEEP this",)], "sentence string"))


def test_a_sentence_that_recurs_in_both_sources(spark):
    rows = [(s, f"{i:03}", 0, "The same line!" if i % 3 else f"line number {i}") for s in (1, 0) for i in range(90)]
    c, ev = spark.createDataFrame(rows, "src int, id string, sent_pos int, sentence string"), spark.createDataFrame([("other",)], "sentence string")
    assert {(r.src, r.bucket): r.n for r in corpus.provenance(c, ev, "src").collect()} == {(0, "kept"): 31, (0, "duplicate"): 59, (1, "duplicate"): 90}
    assert {(r.src, r.id) for r in corpus.kept(c, ev, "src", ["id", "sent_pos"]).collect()} == {(0, f"{i:03}") for i in range(90) if not i % 3} | {(0, "001")}


def test_ngram_model_against_plain_python(spark, tmp_path):
    sents = ["a b a", "a b c", "c", ""]
    order, add_k, lam = 3, 0.1, 0.7
    counts = Counter()
    for s in sents:
        if s:
            t = ["<s>"] * (order - 1) + s.split() + ["</s>"]
            counts.update(tuple(t[i : i + k]) for k in range(1, order + 1) for i in range(len(t) - k + 1))
    total, v = sum(n for g, n in counts.items() if len(g) == 1), len({g for g in counts if len(g) == 1} - {("<s>",)}) + 1

    def logprob(s):
        t = ["<s>"] * (order - 1) + s.split() + ["</s>"]
        out = 0.0
        for i in range(order - 1, len(t)):
            p = (counts[(t[i],)] + add_k) / (total + add_k * v)
            for k in range(2, order + 1):
                g = tuple(t[i - k + 1 : i + 1])
                if counts[g[:-1]]:
                    p = lam * counts[g] / counts[g[:-1]] + (1 - lam) * p
            out += math.log(p)
        return out

    df = spark.createDataFrame([(i, s.split()) for i, s in enumerate(sents)], "id int, t array<string>")
    grams = {(r.k, tuple(r.gram.split())): r.n for r in ngram.ngram_counts(df, "t", order).collect()}
    assert grams == {(len(g), g): n for g, n in counts.items()}
    model = ngram.NGramModel(ngram.ngram_counts(df, "t", order), order, add_k, lam)
    test = ["a b", "z a", "", "c c c"]
    got = {r.id: r for r in model.logprobs(spark.createDataFrame([(i, s.split()) for i, s in enumerate(test)], "id int, t array<string>"), "id", "t").collect()}
    for i, s in enumerate(test):
        assert abs(got[i].logprob - logprob(s)) < 1e-9 and got[i].n_tokens == len(s.split())
    model.save(f"{tmp_path}/model")
    again = ngram.load_model(f"ngram:{tmp_path}/model")(spark.createDataFrame([(1, ["a", "b"])], "id int, t array<string>"), "id", "t").first()
    assert abs(again.logprob - logprob("a b")) < 1e-9
    assert ngram.ngram_counts(df.limit(0), "t", order).collect() == []


def test_model_registry():
    ngram.register_model("const", lambda rest: rest)
    assert ngram.load_model("const:1") == "1"
    with pytest.raises(ValueError):
        ngram.load_model("unknown:x")


def test_rescoring_ties_and_oracle(spark):
    rows = [("u", 0, "a", -1.0, -2.0, 2, 4), ("u", 1, "b", -1.0, -2.0, 1, 4), ("u", 2, "c", -1.5, -0.5, 0, 4)]
    n = spark.createDataFrame(rows, "utt_id string, pos long, text string, acoustic double, lm double, edits int, n_ref int")
    r = rescoring.rescored(n, 1.0).first()
    assert (r.text_baseline, r.text_adapted, r.changed) == ("a", "c", True)
    sweep = rescoring.weight_sweep(n, [0.0, 0.2, 1.0, 2.0])
    assert [x.wer for x in sweep.orderBy("grid_pos").collect()] == [0.5, 0.5, 0.0, 0.0]
    assert sweep.agg(rescoring.best_weight(sweep)).first()[0] == 1.0
    assert [x.wer for x in rescoring.oracle_by_depth(n, [1, 2, 3]).orderBy("depth").collect()] == [0.5, 0.25, 0.0]


def test_hash_split_is_exact(spark):
    df = spark.range(997).select(F.col("id").cast("string").alias("k"))
    split = sampling.first_by_hash(df, "k", "s", share=0.34)
    keys = {r.k: r.chosen for r in split.collect()}
    ranked = [r.k for r in df.orderBy(sampling.hash_key(F.lit("s"), F.col("k")), "k").collect()]
    assert {k for k, c in keys.items() if c} == set(ranked[: int(997 * 0.34)]) and len(keys) == 997
    assert sum(r.chosen for r in sampling.first_by_hash(df.limit(1), "k", "s", share=0.34).collect()) == 1


def test_allocation_and_caps(spark):
    assert sampling.allocate({"a": 100, "b": 2, "c": 10}, 20) == {"a": 14, "b": 2, "c": 4}
    assert sampling.allocate({"a": 1}, 20) == {"a": 1}
    df = spark.createDataFrame([(g, i) for g in "ab" for i in range(9)], "g string, i int")
    assert sorted((r.g, r.i) for r in sampling.cap_per_group(df, "g", ["i"], 2).collect()) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]


def _units(n=60):
    r = random.Random(1)
    return [(f"u{i:03}", 10, r.randrange(4) + 1, r.randrange(2)) for i in range(n)]


def test_bootstrap(spark):
    units = spark.createDataFrame(_units(), "k string, n_ref int, e_base int, e_adapt int")
    draws = sampling.bootstrap(units, "k", 100, 7)
    s = sampling.significance(draws, 100).first()
    assert draws.count() == 100 and s.significant and s.p == 0.0 and s.delta_lo <= s.delta_hi < 0
    rows = [u[1:] for u in _units()]
    for r in draws.collect():
        drawn = [rows[sampling.mixed(7 + i * sampling.UNIT_STEP % 2**32 + r.b * sampling.DRAW_STEP) % 60] for i in range(60)]
        assert abs(r.wer_baseline - sum(x[1] for x in drawn) / sum(x[0] for x in drawn)) < 1e-12
    with pytest.raises(ValueError):
        sampling.bootstrap(units, "k", 10, 7, max_units=59)
    assert sampling.bootstrap(units.limit(0), "k", 10, 7).collect() == []


def test_poisson_bootstrap_has_the_mean_and_spread_of_the_exact_one(spark):
    units = spark.createDataFrame(_units(300), "k string, n_ref int, e_base int, e_adapt int")
    exact, poisson = (f(units, "k", 2000, s).agg(F.avg("delta").alias("m"), F.stddev("delta").alias("s")).first() for f, s in ((sampling.bootstrap, 7), (sampling.poisson_bootstrap, "7")))
    assert abs(exact.m - poisson.m) < exact.s / 5 and abs(exact.s - poisson.s) < exact.s / 5
    assert sampling.poisson_bootstrap(units.limit(0), "k", 10).collect() == []


def test_corpus_model_against_plain_python(spark, tmp_path):
    """4-grams of train texts and documents' lines, without evaluation sentences and repeats."""
    from lectern.plans import language

    u = [("a", "one two three four", "train"), ("b", "One two, three four!", "train"), ("c", "held out words here", "train"), ("d", "Held out words here", "test"), ("e", "two three four five", "dev"), ("f", "x", "train")]
    cols = "utt_id string, text string, split string, dataset string, wav_path string, duration_s double, speaker string, accent string, cefr string, extra map<string,string>, loaded_at int"
    spark.createDataFrame([(*r, "", "", 1.0, "", "", "", None, 0) for r in u], cols).write.parquet(f"{tmp_path}/utterances.parquet")
    spark.createDataFrame([(1, "one two three four\nfour five six seven\nheld out words here"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counts, order = Counter(), 4
    for s in ("one two three four", "four five six seven"):
        t = ["<s>"] * 3 + s.split() + ["</s>"]
        counts.update((k, " ".join(t[i : i + k])) for k in range(1, order + 1) for i in range(len(t) - k + 1))
    assert {(r.k, r.gram): r.n for r in language.ngram_counts(spark, str(tmp_path)).collect()} == counts
    total, v = sum(n for (k, _), n in counts.items() if k == 1), len({g for k, g in counts if k == 1} - {"<s>"}) + 1
    t, logprob = ["<s>"] * 3 + "two three four five".split() + ["</s>"], 0.0
    for i in range(3, len(t)):
        p = (counts[1, t[i]] + 0.1) / (total + 0.1 * v)
        for k in range(2, order + 1):
            h = counts[k - 1, " ".join(t[i - k + 1 : i])]
            p = 0.7 * counts[k, " ".join(t[i - k + 1 : i + 1])] / h + 0.3 * p if h else p
        logprob += math.log(p)
    got = language.interpolated_logprob(spark, str(tmp_path)).collect()
    assert [r.utt_id for r in got] == ["e"] and abs(got[0].logprob - logprob) < 1e-5


def test_counts_of_asked_grams_only(spark):
    r = random.Random(5)
    text = lambda n: " ".join(f"w{r.randrange(40)}" for _ in range(n))
    corpus_, asked = [text(r.randrange(0, 12)) for _ in range(300)] + ["é ü"], [text(r.randrange(0, 9)) for _ in range(20)] + ["é zz"]
    sents, asks = (spark.createDataFrame([(t,) for t in x], "norm string") for x in (corpus_, asked))
    grams = lambda t, k: [" ".join(p[i : i + k]) for p in [["<s>"] * 3 + t.split() + ["</s>"]] for i in range(len(p) - k + 1)]
    want = Counter((k, g) for t in corpus_ if t for k in range(1, 5) for g in grams(t, k))
    got = {(x.k, x.gram): x.n for x in ngram.asked_counts(sents, asks, "norm", 4).collect()}
    assert got.items() <= want.items() and len(got) < len(want) / 2
    assert {g for g in want if g[0] == 1} | {(k, g) for t in asked if t for k in range(2, 5) for g in grams(t, k) if (k, g) in want} <= set(got)
    full = {(x.k, x.gram): x.n for x in ngram.asked_counts(sents, asks, "norm", 4, max_bits=1).collect()}
    assert set(got) <= set(full) and full.items() <= want.items()
    assert ngram.asked_counts(sents.limit(0), asks, "norm", 4).collect() == [] and {x.k for x in ngram.asked_counts(sents, asks.limit(0), "norm", 4).collect()} == {1}


def test_scores_of_texts_are_those_of_the_joins(spark):
    r = random.Random(6)
    text = lambda n, v=30: " ".join(f"w{r.randrange(v)}" for _ in range(n))
    sents = spark.createDataFrame([(text(r.randrange(1, 12)),) for _ in range(200)], "norm string")
    asked = spark.createDataFrame([(i * 7, text(r.randrange(0, 9), 40)) for i in range(60)], "id long, norm string")
    words = lambda d: d.withColumn("t", F.filter(F.split("norm", " "), lambda t: t != ""))
    plain = ngram.NGramModel(ngram.ngram_counts(words(sents), "t", 4))
    model = ngram.NGramModel(ngram.asked_counts(sents, asked, "norm", 4))
    want = {x.id: x for x in plain.logprobs(words(asked), "id", "t").collect()}
    for rows, at_once in ((asked, 250_000), (asked, 100), (asked.filter("norm = ''"), 100), (asked.limit(0), 100)):
        got = {x.id: x for x in model.logprobs_of_texts(rows, "id", "norm", at_once).collect()}
        assert len(got) == rows.count() and all(abs(x.logprob - want[i].logprob) < 1e-9 and x.n_tokens == want[i].n_tokens for i, x in got.items())
