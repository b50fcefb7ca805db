"""P2: records of evaluation splits that also stand, exactly or almost, in the training split.

Edit-distance segment join over words. Two texts of n and m words match if their word edit
distance d satisfies 100 d <= ``percent`` * max(n, m).

1. Equal word sequences are one text; all later steps work on distinct texts.
2. An evaluation text of n words can match texts of at most M = 100 n / (100 - percent) words, so
   with at most k = percent * M / 100 edits. It is cut into k + 1 segments; k edits leave one
   segment whole, at a place shifted by no more than the edits before or after it.
3. Training texts give their substrings of every segment length that some admissible n uses. Words
   are hashed in the JVM; the hashes of all substrings come from prefix sums over an Arrow batch.
   A bitmap of the evaluation segments (at most ``max_bits`` bits, sent to the executors) drops
   substrings that no evaluation text has before anything is shuffled. A bitmap that is too small
   for the segments only lets more substrings through.
4. Both sides meet on the segment; length and the allowed positions (the segment's index bounds
   the shift from the left, the later segments that from the right) are part of the join.
5. Distinct candidate pairs are verified by banded dynamic programming over words, for a batch of
   pairs at a time.
6. Matching texts are expanded to their records.

A segment that many texts of either side share is cut into a grid: its evaluation texts are dealt
over rows and its training texts over columns, so that no task gets it whole. Segments of more than
rows / 10,000 texts are cut, so there are at most 10,000 of them a side: their list is bounded.

Defined results: records without id, text or a known split, and texts under ``min_words``, take
no part; a record delivered twice counts once (the earliest by ``arrived``). Texts are told apart by
their MD5. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.words import joined_words
from lectern.storage import stored

SPLITS = {"train": "train", "validation": "validation", "dev": "validation", "test": "test"}
#: A segment of fewer texts a side is never cut; the most segments that can be cut.
LEAST_HOT, MAX_HOT = 4096, 10_000
_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def split_name(split: Column) -> Column:
    """train, validation, test or NULL, from uneven spellings."""
    bare = F.lower(F.regexp_replace(split, r"^\s+|\s+$", ""))
    return F.create_map(*[F.lit(x) for pair in SPLITS.items() for x in pair])[bare]


def records(rows: DataFrame, min_words: int, arrived: str = "loaded_at") -> DataFrame:
    """(utt_id, split, dataset, text): one row per record; text is its words, joined by one blank."""
    first = rows.filter("utt_id IS NOT NULL").groupBy("utt_id").agg(F.min(F.struct(F.col(arrived), "split", "dataset", "text")).alias("r"))
    of = first.select("utt_id", split_name(F.col("r.split")).alias("split"), F.col("r.dataset").alias("dataset"), joined_words(F.col("r.text")).alias("text"))
    return of.filter(F.col("split").isNotNull() & (F.col("text") != "") & (_n_words() >= min_words))


def _n_words() -> Column:
    return F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit(""))) + 1


def _segments(n: int, percent: int) -> int:
    """Into how many segments an evaluation text of ``n`` words is cut."""
    return percent * (100 * n // (100 - percent)) // 100 + 1


@cache
def _lengths(m: int, percent: int) -> tuple[int, ...]:
    """Segment lengths of all evaluation texts that a text of ``m`` words can match."""
    out: set[int] = set()
    for n in range(-(-(100 - percent) * m // 100), 100 * m // (100 - percent) + 1):
        s = _segments(n, percent)
        out |= {n // s, -(-n // s)}
    return tuple(sorted(x for x in out if 0 < x <= m))


class _Hashes:
    """Hashes of word runs of an Arrow batch's texts, each from two prefix sums."""

    def __init__(self, codes: pa.ListArray) -> None:
        self.sizes = codes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        flat = codes.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(flat), _STEP))))
            self.back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(flat), _BACK))))
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(flat * power[:-1])))

    def of(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Of the runs of ``length`` words from the batch's word ``at``."""
        with np.errstate(over="ignore"):
            x = (self.sums[at + length] - self.sums[at]) * self.back[at]
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + np.asarray(length).astype(np.uint64)
            return (x ^ (x >> np.uint64(29))).view(np.int64)

    def by_size(self) -> Iterator[tuple[int, np.ndarray]]:
        """(number of words, the texts that have so many)."""
        order = np.argsort(self.sizes, kind="stable")
        edges = np.flatnonzero(np.diff(self.sizes[order])) + 1
        for rows in np.split(order, edges):
            if len(rows):
                yield int(self.sizes[rows[0]]), rows


def _cut(percent: int):
    """(id, codes) of evaluation texts -> (id, n, s, i, at, segment)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, h = batch.column(0).to_numpy(), _Hashes(batch.column(1))
            for n, rows in h.by_size():
                s = _segments(n, percent)
                at = np.arange(s + 1, dtype=np.int64) * n // s
                begin, length = np.tile(at[:-1], len(rows)), np.tile(np.diff(at), len(rows))
                segment = h.of(np.repeat(h.starts[rows], s) + begin, length)
                i = np.tile(np.arange(s, dtype=np.int32), len(rows))
                columns = [np.repeat(ids[rows], s), np.full(len(i), n, np.int32), np.full(len(i), s, np.int32), i, begin.astype(np.int32), segment]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "n", "s", "i", "at", "segment"])

    return run


def _substrings(percent: int, bitmap):
    """(id, codes) of training texts -> (id, n, at, segment) of substrings that the bitmap knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        last = len(bits) * 8 - 1
        for batch in batches:
            ids, h = batch.column(0).to_numpy(), _Hashes(batch.column(1))
            for m, rows in h.by_size():
                for length in _lengths(m, percent):
                    at = np.tile(np.arange(m - length + 1, dtype=np.int64), len(rows))
                    of = np.repeat(rows, m - length + 1)
                    segment = h.of(h.starts[of] + at, length)
                    bit = segment & last
                    known = np.flatnonzero((bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
                    if len(known):
                        columns = [ids[of[known]], np.full(len(known), m, np.int32), at[known].astype(np.int32), segment[known]]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "n", "at", "segment"])

    return run


def _bitmap(segments: DataFrame, n: int, max_bits: int) -> bytearray:
    """Bits of the segments' low ends; at least 32 a segment unless ``max_bits`` is too small for that."""
    size = max(1 << 15, min(max_bits, 1 << max(0, 32 * n - 1).bit_length()))
    bit = segments.select(F.col("segment").bitwiseAND(F.lit(size - 1)).alias("b"))
    parts = bit.groupBy(F.shiftright("b", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("b").bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
    out = bytearray(size // 8)
    for r in parts.toLocalIterator():
        out[r.part * 4096 : (r.part + 1) * 4096] = r.bits
    return out


def _spread(e: DataFrame, t: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the grid cell (x, y) at which a segment's texts meet."""
    most = max(LEAST_HOT, rows // MAX_HOT)
    count = lambda of, c: of.groupBy("segment").agg(F.count("*").alias(c)).filter(F.col(c) > most)
    hot = stored(count(e, "ce").join(count(t, "ct"), "segment", "full"), "hot-segments")
    if hot.isEmpty():
        none = F.lit(0)
        return e.withColumns({"x": none, "y": none}), t.withColumns({"x": none, "y": none})
    parts = lambda c: F.ceil(F.coalesce(F.col(c), F.lit(1)) / most).cast("int")
    hot = F.broadcast(hot.select("segment", parts("ce").alias("nx"), parts("ct").alias("ny")))  # at most 2 * MAX_HOT rows
    one = F.lit(1)
    deal = lambda n: F.pmod(F.hash("id"), F.coalesce(n, one))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, one) - 1))
    e = e.join(hot, "segment", "left").withColumn("x", deal(F.col("nx"))).withColumn("y", all_of(F.col("ny"))).drop("nx", "ny")
    t = t.join(hot, "segment", "left").withColumn("y", deal(F.col("ny"))).withColumn("x", all_of(F.col("nx"))).drop("nx", "ny")
    return e, t


def banded_distances(a: list[np.ndarray], b: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """Edit distances of the code sequences' pairs; over ``most`` edits, some number above it.

    One dynamic programme for all pairs: row i holds the columns i - w .. i + w; insertions within
    a row are a running minimum."""
    w = int(most.max()) if len(most) else 0
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    rows, far = len(a), np.int32(1 << 20)
    left = np.full((rows, la.max() if rows else 0), -1, np.int32)
    right = np.full((rows, (lb.max() if rows else 0) + la.max(initial=0) + 2 * w + 1), -2, np.int32)
    for k, (x, y) in enumerate(zip(a, b)):
        left[k, : len(x)] = x
        right[k, w + 1 : w + 1 + len(y)] = y  # column j stands at w + j
    ramp = np.arange(2 * w + 1, dtype=np.int32)
    row = np.where(ramp >= w, ramp - w, far)[None, :].repeat(rows, 0).astype(np.int32)
    out = np.where(np.abs(lb - la) <= w, row[np.arange(rows), np.clip(lb - la + w, 0, 2 * w)], far)
    for i in range(1, left.shape[1] + 1):
        same = row + (right[:, i : i + 2 * w + 1] != left[:, i - 1 : i])
        above = np.concatenate((row[:, 1:] + 1, np.full((rows, 1), far, np.int32)), 1)
        row = np.minimum(same, above).astype(np.int32)
        if i <= w:
            row[:, w - i] = i  # column 0
            row[:, : w - i] = far
        row = np.minimum.accumulate(row - ramp, axis=1) + ramp
        done = np.flatnonzero((la == i) & (np.abs(lb - la) <= w))
        out[done] = row[done, lb[done] - i + w]
    return out


def _verify(percent: int, cells: int = 4_000_000):
    """(key_eval, key_train, a, b) -> (key_eval, key_train, distance) of the pairs within the bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word: dict[str, int] = {}
            coded: list[list[np.ndarray]] = []
            for side in (2, 3):
                known: dict[str, np.ndarray] = {}
                out = []
                for text in batch.column(side).to_pylist():
                    if text not in known:
                        known[text] = np.array([word.setdefault(x, len(word)) for x in text.split(" ")], np.int32)
                    out.append(known[text])
                coded.append(out)
            longest = np.array([max(len(x), len(y)) for x, y in zip(*coded)], np.int64)
            order = np.argsort(longest, kind="stable")
            found, distance = [], []
            at = 0
            while at < len(order):
                # as many pairs as keep the band's table small; the longest comes last
                size = 1
                while at + size < len(order) and (size + 1) * (longest[order[at + size]] + 1) <= cells // 8:
                    size *= 2
                part = order[at : at + size]
                at += size
                most = percent * longest[part] // 100
                d = banded_distances([coded[0][k] for k in part], [coded[1][k] for k in part], most)
                found.append(part[d <= most])
                distance.append(d[d <= most])
            if found:
                rows = pa.array(np.concatenate(found))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.concatenate(distance).astype(np.int32))], names=["key_eval", "key_train", "distance"])

    return run


def matching_texts(texts: DataFrame, percent: int = 15, max_bits: int = 1 << 28) -> DataFrame:
    """(key_eval, key_train, distance) of distinct texts (id, key, text, in_eval, in_train)."""
    spark = texts.sparkSession
    coded = lambda which: texts.filter(which).select("id", F.transform(F.split("text", " "), lambda w: F.xxhash64(w)).alias("codes"))
    e = stored(coded("in_eval").mapInArrow(_cut(percent), "id long, n int, s int, i int, at int, segment long"), "segments")
    n_e = e.count()
    bitmap = spark.sparkContext.broadcast(bytes(_bitmap(e, n_e, max_bits)))  # at most max_bits / 8 bytes
    t = stored(coded("in_train").mapInArrow(_substrings(percent, bitmap), "id long, n int, at int, segment long"), "substrings")
    e, t = (x.alias(name) for x, name in zip(_spread(e, t, n_e + t.count()), "et"))
    near = F.expr(
        f"""t.n BETWEEN ({100 - percent} * e.n + 99) DIV 100 AND 100 * e.n DIV {100 - percent}
        AND t.at - e.at BETWEEN -e.i AND e.i
        AND (t.at - e.at) - (t.n - e.n) BETWEEN e.i - e.s + 1 AND e.s - 1 - e.i"""
    )
    same = [F.col(f"e.{c}") == F.col(f"t.{c}") for c in ("segment", "x", "y")]
    candidates = e.join(t, [*same, near]).select(F.col("e.id").alias("id_eval"), F.col("t.id").alias("id_train")).distinct()
    side = lambda s, c: texts.filter(f"in_{s}").select(F.col("id").alias(f"id_{s}"), F.col("key").alias(f"key_{s}"), F.col("text").alias(c))
    pairs = candidates.join(side("eval", "a"), "id_eval").join(side("train", "b"), "id_train").select("key_eval", "key_train", "a", "b")
    return pairs.mapInArrow(_verify(percent), "key_eval binary, key_train binary, distance int")


def split_overlaps(rows: DataFrame, min_words: int = 6, percent: int = 15, max_bits: int = 1 << 28) -> DataFrame:
    """(eval_id, eval_split, eval_dataset, train_id, train_dataset, distance): every overlap."""
    of = stored(records(rows, min_words).withColumn("key", F.unhex(F.md5("text"))), "split-records")
    texts = of.groupBy("key", "text").agg(F.max(F.col("split") != "train").alias("in_eval"), F.max(F.col("split") == "train").alias("in_train"))
    texts = stored(texts.withColumn("id", F.monotonically_increasing_id()), "split-texts")
    matches = stored(matching_texts(texts, percent, max_bits), "text-matches")
    left = of.filter("split <> 'train'").select(F.col("key").alias("key_eval"), F.col("utt_id").alias("eval_id"), F.col("split").alias("eval_split"), F.col("dataset").alias("eval_dataset"))
    right = of.filter("split = 'train'").select(F.col("key").alias("key_train"), F.col("utt_id").alias("train_id"), F.col("dataset").alias("train_dataset"))
    # copies of one text: its evaluation records meet the matched texts, then their training records
    return matches.join(left, "key_eval").join(right, "key_train").select("eval_id", "eval_split", "eval_dataset", "train_id", "train_dataset", "distance")
