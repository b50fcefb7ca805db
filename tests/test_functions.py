from pyspark.sql import functions as F

from lectern.functions import phonetics
from lectern.functions.distance import align, alignment, cer, with_word_edits
from lectern.functions.text import context_frame, normalize, shorten, tokens
from lectern.functions.words import joined_words, joined_words_of, words, words_of


def one(df):
    return df.first()[0]


def test_normalize(spark):
    cases = {
        "  Hello,  WORLD! ": "hello world", "don't 'cause dogs' rock'n'roll": "don't cause dogs rock'n'roll", "o''k": "o k", "it's-é'a café’s": "it's é a café s",
        "a_b\t1.5": "a_b 1 5", "": "", "...": "",
    }
    rows = spark.createDataFrame(list(cases.items()), "t string, want string")
    for r in rows.select("want", normalize(F.col("t")).alias("got"), F.size(tokens(F.col("t"))).alias("n")).collect():
        assert r.got == r.want and r.n == len(r.want.split())


def test_words_agree_in_jvm_and_python(spark):
    texts = ["It’s A_b 'x'", "12½ ​z﻿q", "Ünïcode—dash", "", " ", "a.b,c", "ABC123 d'e"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", words(F.col("t")).alias("w"), joined_words(F.col("t")).alias("j")).collect()
    for r in rows:
        assert r.w == words_of(r.t) and r.j == joined_words_of(r.t)


def test_edits_and_wer(spark):
    pairs = [("a b c d".split(), "a x c".split()), ([], ["a"]), (["a"], []), ("the cat the cat".split(), "cat the cat the".split())]
    got = with_word_edits(spark.createDataFrame(pairs, "r array<string>, h array<string>"), "r", "h").collect()
    for (r, h), row in zip(pairs, got):
        assert row.edits == len(align(r, h)) and row.wer == (row.edits / len(r) if r else None)
    assert one(spark.createDataFrame([("abcd", "abxd")], "r string, h string").select(cer(F.col("r"), F.col("h")))) == 0.25


def test_alignment_prefers_deletions_from_the_end(spark):
    assert align(["a", "a"], ["a"]) == [("delete", "a", None, 1, None)] or align(["a", "a"], ["a"])[0][0] == "delete"
    assert [o[0] for o in align("x y".split(), "y z".split())] in (["delete", "insert"], ["substitute", "substitute"])
    got = one(spark.createDataFrame([("a b c".split(), "a x c d".split())], "r array<string>, h array<string>").select(alignment("r", "h")))
    assert [tuple(o) for o in got] == [("substitute", "b", "x", 1, 1), ("insert", None, "d", None, 3)]
    assert one(spark.createDataFrame([(None, ["a"])], "r array<string>, h array<string>").select(alignment("r", "h"))) == []


def test_frames(spark):
    t = spark.createDataFrame([("a b c d e f g h".split(), [0, 3, 7, None])], "t array<string>, at array<int>").select("t", F.explode("at").alias("at"))
    assert [r[0] for r in t.select(context_frame(F.col("t"), F.col("at"))).collect()] == ["[a] b c d", "a b c [d] e f g", "e f g [h]", ""]
    s = spark.createDataFrame([("a b c d e f g h".split(), "a x c d e f g z".split())], "t array<string>, o array<string>")
    assert one(s.select(shorten(F.col("t"), F.col("o")))) == "a B c … f g H"


def test_phonetics():
    assert abs(phonetics.jaro_winkler("martha", "marhta") - 0.961111) < 1e-6 and abs(phonetics.jaro_winkler("dixon", "dicksonx") - 0.813333) < 1e-6
    assert phonetics.metaphone("phone") == "FN" and phonetics.metaphone("knight") == phonetics.metaphone("night")
    assert phonetics.similar("their", "there") and not phonetics.similar("cat", "cat") and not phonetics.similar(None, "cat") and not phonetics.similar("harbour", "six")
