"""Interpolated n-gram language model as count tables and joins."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.storage import stored

BOS, EOS = "<s>", "</s>"


def padded(tokens: Column, order: int) -> Column:
    return F.concat(F.array_repeat(F.lit(BOS), order - 1), tokens, F.array(F.lit(EOS)))


def ngram_counts(sentences: DataFrame, tokens: str, order: int) -> DataFrame:
    """(k, gram, n) for k = 1 .. order; grams are joined by a blank; empty sentences are passed over.

    Only the grams of the highest order are made of the text. A gram that ends anywhere but in the padding is the
    end of one that is longer by a word, so lower orders are sums of the counts above them; the
    gram of k start marks, which ends at place k, stands once more a sentence. Each order's table is stored.
    """
    of = sentences.filter(F.size(tokens) > 0).select(padded(F.col(tokens), order).alias("t"))
    windows = F.transform(F.sequence(F.lit(1), F.size("t") - order + 1), lambda i: F.array_join(F.slice("t", i, order), " "))
    counts = stored(of.select(F.explode(windows).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")), f"{order}-grams")
    n_sentences = counts.agg(F.coalesce(F.sum(F.when(F.substring_index("gram", " ", -1) == EOS, F.col("n"))), F.lit(0)).alias("n")).filter("n > 0")
    out = counts.select(F.lit(order).alias("k"), "gram", "n")
    for k in range(order - 1, 0, -1):
        marks = n_sentences.select(F.lit(" ".join([BOS] * k)).alias("gram"), "n")
        counts = counts.select(F.substring_index("gram", " ", -k).alias("gram"), "n").unionByName(marks).groupBy("gram").agg(F.sum("n").alias("n"))
        counts = stored(counts, f"{k}-grams")
        out = out.unionByName(counts.select(F.lit(k).alias("k"), "gram", "n"))
    return out


class _Grams:
    """The padded words of texts (words joined by one blank) one after another, as codes."""

    def __init__(self, texts: pa.Array, order: int) -> None:
        some = pc.not_equal(texts, "").to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(texts.filter(pa.array(some)), " ")
        coded = lists.flatten().dictionary_encode()
        self.lengths = lengths = np.zeros(len(texts), np.int64)
        lengths[some] = pc.list_value_length(lists).to_numpy()
        ends = np.cumsum(lengths + order)
        n_words = len(coded.dictionary)
        self.words = pa.concat_arrays([coded.dictionary, pa.array([BOS, EOS], coded.dictionary.type)])
        self.codes = np.full(int(ends[-1]) if len(ends) else 0, n_words, np.int64)
        self.codes[ends - 1] = n_words + 1
        self.text = np.repeat(np.arange(len(ends)), lengths + order)
        of = np.repeat(np.arange(len(ends)), lengths)
        self.codes[np.arange(len(of)) + order * of + order - 1] = coded.indices.to_numpy()
        self.hash = pd.util.hash_array(self.words.to_numpy(zero_copy_only=False), categorize=False)[self.codes]

    def bits(self, order: int, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, first places, bit of a map of ``size`` bits, a power of two) of all grams, k = 2 .. ``order``."""
        h = self.hash
        for k in range(2, order + 1):
            h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + self.hash[k - 1 :]
            at = np.flatnonzero(self.text[: len(h)] == self.text[k - 1 :])
            x = h[at]
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
            yield k, at, ((x ^ (x >> np.uint64(29))) & np.uint64(size - 1)).astype(np.int64)

    def distinct(self, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the grams of k words at these places: the first place of each, the number of each place's gram, how many there are."""
        codes, n = self.codes, len(self.words)
        ids = codes[at]
        for j in range(1, k):
            ids = (np.unique(ids, return_inverse=True)[1] if j > 1 else ids) * n + codes[at + j]
        _, first, ids, n_of = np.unique(ids, return_index=True, return_inverse=True, return_counts=True)
        return at[first], ids, n_of

    def strings(self, k: int, at: np.ndarray) -> pa.Array:
        return pc.binary_join_element_wise(*[self.words.take(pa.array(self.codes[at + j])) for j in range(k)], " ")

    def counts(self, k: int, at: np.ndarray) -> pa.RecordBatch:
        """(k, gram, n) of the grams of k words at these places."""
        first, _, n = self.distinct(k, at)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(first), k, np.int32)), self.strings(k, first), pa.array(n.astype(np.int64))], names=["k", "gram", "n"])

    def places(self, order: int) -> Iterator[tuple[int, np.ndarray]]:
        """(k, first places of all grams of k words)."""
        for k in range(1, order + 1):
            yield k, np.flatnonzero(self.text[: max(0, len(self.text) - k + 1)] == self.text[k - 1 :])

    def asked(self, order: int) -> pa.Array:
        """All distinct grams; ``scores`` takes their counts by the place in this list."""
        return pa.concat_arrays([self.strings(k, self.distinct(k, at)[0]) for k, at in self.places(order)])

    def scores(self, place: np.ndarray, n: np.ndarray, total: int, vocabulary: int, add_k: float, weight: float, order: int) -> np.ndarray:
        """The logarithm of each text's probability, from the counts that aren't 0 and their places in ``asked``."""
        before = p = np.zeros(0)
        begin = 0
        for k, at in self.places(order):
            first, ids, _ = self.distinct(k, at)
            counts = np.zeros(len(first))
            of = (place >= begin) & (place < begin + len(first))
            counts[place[of] - begin] = n[of]
            begin += len(first)
            now = np.zeros(len(self.codes))  # by the gram's last place
            now[at + k - 1] = counts[ids]
            if k == 1:
                p = (now + add_k) / (total + add_k * vocabulary)
            else:
                h = np.concatenate(([0.0], before[:-1]))
                p = np.where(h > 0, weight * (now / np.where(h > 0, h, 1)) + (1 - weight) * p, p)
            before = now
        start = np.cumsum(self.lengths + order) - self.lengths - order
        scored = np.arange(len(self.codes)) - start[self.text] >= order - 1
        return np.bincount(self.text[scored], np.log(np.maximum(p[scored], 1e-12)), len(self.lengths))


def _pieces(batches: Iterator[pa.RecordBatch], characters: int = 8_000_000) -> Iterator[pa.Array]:
    """The texts of the first column in pieces of about so many characters."""
    held, n = [], 0
    for batch in batches:
        held.append(batch.column(0))
        n += held[-1].nbytes
        if n >= characters:
            yield pa.concat_arrays(held)
            held, n = [], 0
    if any(map(len, held)):
        yield pa.concat_arrays(held)


def _places(texts: DataFrame, text: str, order: int) -> int:
    """At least the number of the padded texts' words."""
    return texts.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1 + order).alias("n")).first().n or 0


def _asked_bits(asked: DataFrame, text: str, order: int, max_bits: int) -> bytes:
    """A bitmap of all grams of the texts: eight bits or more for each place, at most ``max_bits``."""
    size = max(1 << 15, min(max_bits, 1 << (8 * (order - 1) * _places(asked, text, order)).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _pieces(batches):
            for _, _, bit in _Grams(texts, order).bits(order, size):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(bit))], names=["b"])

    low = F.col("b").bitwiseAND(F.lit((1 << 15) - 1))
    parts = asked.select(text).mapInArrow(run, "b long").groupBy(F.shiftright("b", 15).alias("part")).agg(F.bitmap_construct_agg(low).alias("bits"))
    out = bytearray(size // 8)
    for r in parts.toLocalIterator():
        out[r.part * 4096 : (r.part + 1) * 4096] = r.bits
    return bytes(out)


def asked_counts(sentences: DataFrame, asked: DataFrame, text: str, order: int, max_bits: int = 1 << 28) -> DataFrame:
    """(k, gram, n): of ``ngram_counts`` all words, and of the longer grams at least those that the ``asked`` texts hold.

    Enough to score these texts, with the totals of the whole corpus. Both have a column ``text`` of words joined by a
    blank. A bitmap of the asked grams (``max_bits`` / 8 bytes at most, sent to the executors) drops others before
    anything is shuffled; one that is too small for all of them only drops fewer.
    """
    bitmap = sentences.sparkSession.sparkContext.broadcast(_asked_bits(asked, text, order, max_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        for texts in _pieces(batches):
            grams = _Grams(texts, order)
            yield grams.counts(1, np.arange(len(grams.codes)))
            for k, at, bit in grams.bits(order, len(bits) * 8):
                yield grams.counts(k, at[((bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)])

    parts = sentences.select(text).filter(F.col(text) != "").mapInArrow(run, "k int, gram string, n long")
    return stored(parts.groupBy("k", "gram").agg(F.sum("n").alias("n")), "asked-grams")


def ngram_stats(counts: DataFrame) -> DataFrame:
    """(k, n_distinct, n_total); the vocabulary is that of k = 1 without the start mark, with the unknown mark."""
    return counts.groupBy("k").agg(F.count("*").alias("n_distinct"), F.sum("n").alias("n_total"))


@dataclass(frozen=True)
class NGramModel:
    """Counts, and the two numbers of the unigram estimate."""

    counts: DataFrame
    order: int = 4
    add_k: float = 0.1
    weight: float = 0.7

    def totals(self) -> tuple[int, int]:
        """(total of unigrams with start marks, vocabulary without the start mark and with the unknown mark)."""
        r = self.counts.filter("k = 1").agg(F.sum("n").alias("n"), F.count_if(F.col("gram") != BOS).alias("v")).first()
        return r.n or 0, (r.v or 1) + 1

    def logprobs(self, sentences: DataFrame, key: str, tokens: str) -> DataFrame:
        """(key, logprob, n_tokens, per_word): natural logarithms, the end mark is scored.

        A token's probability is that of its window, the ``order`` words that end with it. Each
        distinct window is estimated once: it becomes a row for each k, joined with the counts of its gram
        and of its history, and is folded from the lowest order. Then windows meet the sentences.
        """
        total, vocabulary = self.totals()
        o = self.order
        of = sentences.select(F.col(key).alias("key"), padded(F.col(tokens), o).alias("t"))
        windows = F.transform(F.sequence(F.lit(o), F.size("t")), lambda i: F.array_join(F.slice("t", i - o + 1, o), " "))
        rows = of.select("key", F.explode(windows).alias("window"))
        gram = lambda k: F.substring_index("window", " ", -k)
        grams = F.array(*[F.struct(F.lit(k).alias("k"), gram(k).alias("gram"), (F.substring_index(gram(k), " ", k - 1) if k > 1 else F.lit("")).alias("history")) for k in range(1, o + 1)])
        parts = rows.select("window").distinct().select("window", F.explode(grams).alias("g")).select("window", "g.*")
        sub = self.counts.select("k", "gram", F.col("n").alias("c"))
        history = self.counts.filter(F.col("k") < o).select((F.col("k") + 1).alias("k"), F.col("gram").alias("history"), F.col("n").alias("h"))
        found = parts.join(sub, ["k", "gram"], "left").join(history, ["k", "history"], "left")
        of_k = F.array_sort(F.collect_list(F.struct("k", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("h", F.lit(0)).alias("h"))))  # one entry for each k
        by_window = found.groupBy("window").agg(of_k.alias("g"))
        first = (F.get("g", F.lit(0))["c"] + self.add_k) / F.lit(total + self.add_k * vocabulary)
        p = F.aggregate(F.slice("g", 2, o), first, lambda p, g: F.when(g["h"] > 0, self.weight * (g["c"] / g["h"]) + (1 - self.weight) * p).otherwise(p))
        estimates = by_window.select("window", F.log(F.greatest(p, F.lit(1e-12))).alias("log"))
        by_sentence = rows.join(estimates, "window").groupBy("key").agg(F.sum("log").alias("logprob"), (F.count("*") - 1).alias("n_tokens"))
        return by_sentence.select(F.col("key").alias(key), "logprob", "n_tokens", (F.col("logprob") / (F.col("n_tokens") + 1)).alias("per_word"))

    def logprobs_of_texts(self, sentences: DataFrame, key: str, text: str, at_once: int = 1_000_000) -> DataFrame:
        """``logprobs`` of texts of words joined by a blank, for many of them: (key, logprob, n_tokens, per_word).

        Texts are dealt into blocks of about ``at_once`` places, those of 64 successive keys (long) together. A block asks for
        each of its grams once, by a number, gets the counts of those that there are, and is scored whole.
        """
        total, vocabulary = self.totals()
        o, add_k, weight = self.order, self.add_k, self.weight
        places = _places(sentences, text, o)
        block = F.pmod(F.xxhash64(F.floor(F.col(key) / 64)), F.lit(places // at_once + 1)).cast("int")
        rows = sentences.select(block.alias("block"), F.col(key).cast("long").alias("key"), F.col(text).alias("text"))

        def grams_of(of: pa.Table) -> tuple[pa.Table, _Grams]:
            of = of.sort_by([("key", "ascending"), ("text", "ascending")])  # both times in one order
            return of, _Grams(of["text"].combine_chunks(), o)

        def ask(of: pa.Table) -> pa.Table:
            asked = grams_of(of)[1].asked(o)
            return pa.table({"block": pa.repeat(of["block"][0], len(asked)), "place": np.arange(len(asked), dtype=np.int32), "gram": asked})

        def score(of: pa.Table, found: pa.Table) -> pa.Table:
            if not of.num_rows:
                return pa.table({"key": pa.array([], pa.int64()), "logprob": pa.array([], pa.float64()), "n_tokens": pa.array([], pa.int64())})
            of, grams = grams_of(of)
            return pa.table({"key": of["key"], "logprob": grams.scores(found["place"].to_numpy(), found["n"].to_numpy(), total, vocabulary, add_k, weight, o), "n_tokens": grams.lengths})

        asked = rows.groupBy("block").applyInArrow(ask, "block int, place int, gram string")
        found = stored(asked.join(self.counts.select("gram", "n"), "gram").select("block", "place", "n"), "found-grams")
        scored = rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(score, "key long, logprob double, n_tokens long")
        return scored.select(F.col("key").alias(key), "logprob", "n_tokens", (F.col("logprob") / (F.col("n_tokens") + 1)).alias("per_word"))

    def save(self, path: str) -> None:
        """The counts as a Parquet table by order, the settings beside it."""
        self.counts.write.mode("overwrite").partitionBy("k").parquet(f"{path}/counts")
        setting = self.counts.sparkSession.createDataFrame([(self.order, self.add_k, self.weight)], "order int, add_k double, weight double")
        setting.coalesce(1).write.mode("overwrite").json(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NGramModel:
        r = spark.read.schema("order int, add_k double, weight double").json(f"{path}/settings").first()
        return cls(spark.read.parquet(f"{path}/counts").select("k", "gram", "n"), r["order"], r.add_k, r.weight)


def perplexity_micro(scored: DataFrame) -> Column:
    return F.exp(-F.sum("logprob") / F.sum(scored["n_tokens"] + 1))


def perplexity_macro() -> Column:
    return F.exp(-F.avg("per_word"))


_MODELS: dict = {}


def register_model(prefix: str, make) -> None:
    """Plug in a language model: ``make(name)`` gives a function (sentences, key, tokens) -> scored rows."""
    _MODELS[prefix] = make


def load_model(name: str):
    """The model that a name's prefix (before ':') selects; unknown names raise ValueError."""
    prefix, _, rest = name.partition(":")
    if prefix not in _MODELS:
        raise ValueError(f"unknown language model: {name}")
    return _MODELS[prefix](rest)


def _saved(path: str):
    return lambda sentences, key, tokens: NGramModel.load(sentences.sparkSession, path).logprobs(sentences, key, tokens)


register_model("ngram", _saved)  # ngram:<path of a saved model>


def to_natural(log10: Column) -> Column:
    """Base-10 logarithms, as external toolkits give them, to natural ones."""
    return log10 * F.log(F.lit(10.0))
