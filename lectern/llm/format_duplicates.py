"""P5: records that differ in white space, case, punctuation or the order of their fields only.

Recursive radix partitioning on canonical bytes:

1. ``canonical`` gives every text its canonical form; equal forms are copies. The forms are
   written once to the shared folder.
2. The forms are radix partitioned by their first ``step`` bytes; a bucket is known by the length and the
   hash of its prefix. Buckets of more than ``bucket_rows`` rows are split by further bytes, again and
   again, until each fits. A level first counts, and reads only the rows of oversized buckets again:
   what these have in common is found from their least and greatest form, so that a level skips all of it
   and every level splits. A level's table has a row of numbers for each oversized bucket, and there
   are at most rows / bucket_rows <= ``MAX_SPLIT`` of them; it is joined by broadcast.
3. A bucket whose rows are all the same form can't be split by bytes. Its rows are dealt over several
   buckets by id, and the smallest id, found with its level, is the first of its counter in each.
4. All rows are placed by bucket, sorted by bucket and id, and read into one trie a bucket, whose
   terminal nodes count. A task holds one bucket's trie at a time.

Defined results: rows without id or text, and texts under ``min_words`` words, take no part; an id
delivered twice counts once; the smallest id of a group is its first. Texts with '=' are lists of
fields parted by '|' or ';', equal if their multisets of non-empty fields are; they never equal a
text without '='. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.words import joined_words
from lectern.storage import stored

CHUNK = 8
#: The most buckets of a level that may be split: a bucket holds at least rows / MAX_SPLIT rows.
MAX_SPLIT = 10_000


def canonical(text: Column) -> Column:
    """The canonical form: fields (marked '=') sorted, or plain words."""
    fields = F.array_sort(F.filter(F.transform(F.split(text, "[|;]"), joined_words), lambda w: w != ""))
    return F.when(F.contains(text, F.lit("=")), F.concat(F.lit("="), F.array_join(fields, "|"))).otherwise(joined_words(text))


def _n_words(form: Column) -> Column:
    return F.when(form.isin("", "="), 0).otherwise(F.length(form) - F.length(F.translate(form, " |", "")) + 1)


class _Trie:
    """Terminal counters by canonical bytes; nodes are keyed by CHUNK bytes."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, key: bytes, row: int, least: int | None) -> int | None:
        """The first id of this form; None if the row was here before. Rows must come in order of their ids.
        ``least`` is the first id where the form's rows are dealt over several tries."""
        node = self.root
        for i in range(0, len(key), CHUNK):
            node = node.setdefault(key[i : i + CHUNK], {})
        counter = node.get(None)
        if counter is None:
            first = row if least is None else least
            node[None] = [first, row, 1]
            return first
        if counter[1] == row:  # the same record delivered again
            return None
        counter[1] = row
        counter[2] += 1
        return counter[0]


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, id, form, least) sorted by bucket and id -> (first_id, id), also for each first."""
    trie, current = _Trie(), None
    for batch in batches:
        firsts, ids = [], []
        for bucket, row, form, least in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if bucket != current:
                trie, current = _Trie(), bucket
            first = trie.add(form, row, least)
            if first is not None:
                firsts.append(first)
                ids.append(row)
        yield pa.RecordBatch.from_arrays([pa.array(firsts, pa.int64()), pa.array(ids, pa.int64())], names=["first_id", "id"])


@F.pandas_udf(T.IntegerType())
def _common(lo: pd.Series, hi: pd.Series) -> pd.Series:
    """Length of the common prefix; -1 if the two are equal."""
    return pd.Series([-1 if a == b else len(os.path.commonprefix([a, b])) for a, b in zip(map(bytes, lo), map(bytes, hi))], dtype="int32")


def _prefix_hash(depth: Column) -> Column:
    return F.xxhash64(F.substring(F.col("form"), F.lit(1), depth))


def _split(forms: DataFrame, bucket_rows: int, step: int) -> DataFrame:
    """Adds bucket and least (the smallest id, for the rows of a form that is dealt over several buckets)."""
    of = forms.withColumns({"depth": F.lit(step), "least": F.lit(None).cast("long"), "deal": F.lit(1)}).withColumn("prefix", _prefix_hash(F.col("depth")))
    rest, level = of, 0
    key = ["depth", "prefix"]
    while True:
        level += 1
        over = stored(rest.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > bucket_rows), f"oversized-{level}")
        if over.isEmpty():
            break
        rest = rest.join(F.broadcast(over.select(*key)), key)  # at most MAX_SPLIT rows of numbers
        bounds = rest.groupBy(*key).agg(F.count("*").alias("n"), F.min("id").alias("own"), F.min("form").alias("lo"), F.max("form").alias("hi"))
        same = F.col("common") < 0
        table = bounds.select(*key, "n", "own", _common("lo", "hi").alias("common")).select(
            *key, F.when(same, F.col("own")).alias("own"), F.when(~same, F.col("common") + step).alias("next"), F.when(same, F.ceil(F.col("n") / bucket_rows)).cast("int").alias("parts")
        )
        table = stored(table, f"splits-{level}")
        deeper = F.coalesce("next", "depth")
        # rows of one form only are done: their depth is NULL and meets no table again
        move = lambda x: (
            x.join(F.broadcast(table), key, "left")
            .withColumns({"least": F.coalesce("own", "least"), "deal": F.coalesce("parts", "deal"), "depth": F.when(F.col("own").isNull(), deeper)})
            .withColumn("prefix", F.when(F.col("depth").isNotNull(), _prefix_hash(F.col("depth"))).otherwise(F.col("prefix")))
            .select("id", "form", "depth", "prefix", "least", "deal")
        )
        of, rest = move(of), move(rest).filter("depth IS NOT NULL")
        if level % 8 == 0:  # keep the plan short
            of, rest = stored(of, f"placed-{level}"), stored(rest, f"rest-{level}")
    return of.withColumn("bucket", F.xxhash64("depth", "prefix", F.pmod(F.xxhash64("id"), F.col("deal"))))


def copies(rows: DataFrame, row_id: str, text: str, min_words: int = 6, bucket_rows: int = 50_000, step: int = 4) -> DataFrame:
    """(first_id, id): every record with the first of its group, firsts with themselves."""
    given = rows.select(rows[row_id].cast("long").alias("id"), rows[text].alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    form = canonical(F.col("text"))
    forms = stored(given.select("id", F.encode(form, "UTF-8").alias("form"), _n_words(form).alias("n")), "forms").filter(F.col("n") >= min_words).drop("n")
    placed = _split(forms, max(bucket_rows, forms.count() // MAX_SPLIT), step)
    placed = placed.select("bucket", "id", "form", "least").repartition("bucket").sortWithinPartitions("bucket", "id")
    return placed.mapInArrow(_count_buckets, "first_id long, id long")
