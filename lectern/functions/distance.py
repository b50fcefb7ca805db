"""Edit distances over words and characters, and alignments."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def characters(codes: Column) -> Column:
    """A string with one character for each code (0 .. 2**20 - 1), all beyond the surrogates."""
    return F.decode(F.unhex(F.array_join(F.transform(codes, lambda c: F.lpad(F.hex(c + 65536), 8, "0")), "")), "UTF-32")


def with_word_edits(pairs: DataFrame, ref: str, hyp: str) -> DataFrame:
    """Adds n_ref, n_hyp, edits (word edit distance) and wer (NULL for an empty reference).

    Each pair's distinct words get characters of their own, so the built-in ``levenshtein`` counts
    words; nothing leaves the JVM.
    """
    of = pairs.withColumn("_words", F.array_distinct(F.concat(ref, hyp)))
    place = lambda c: characters(F.transform(F.col(c), lambda w: F.array_position(F.col("_words"), w)))
    of = of.withColumns({"n_ref": F.size(ref), "n_hyp": F.size(hyp), "edits": F.levenshtein(place(ref), place(hyp))})
    return of.withColumn("wer", F.when(F.col("n_ref") > 0, F.col("edits") / F.col("n_ref"))).drop("_words")


def cer(ref: Column, hyp: Column) -> Column:
    """Character error rate of normalised texts, blanks counted; NULL for an empty reference."""
    return F.when(F.length(ref) > 0, F.levenshtein(ref, hyp) / F.length(ref))


_FIELDS = [("op", T.StringType()), ("ref_word", T.StringType()), ("hyp_word", T.StringType()), ("ref_idx", T.IntegerType()), ("hyp_idx", T.IntegerType())]
OPS = T.ArrayType(T.StructType([T.StructField(*f) for f in _FIELDS]))


def align(ref: list[str], hyp: list[str]) -> list[tuple]:
    """Edit operations of an optimal alignment in order; traced from the end, a deletion is taken
    before a match or substitution, and that before an insertion."""
    if ref == hyp:
        return []
    n, m = len(ref), len(hyp)
    cost = [list(range(m + 1))]
    for i in range(1, n + 1):
        above, row, r = cost[-1], [i], ref[i - 1]
        for j in range(1, m + 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (r != hyp[j - 1])))
        cost.append(row)
    ops: list[tuple] = []
    i, j = n, m
    while i or j:
        here = cost[i][j]
        if i and cost[i - 1][j] + 1 == here:
            i -= 1
            ops.append(("delete", ref[i], None, i, None))
        elif i and j and cost[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]) == here:
            i, j = i - 1, j - 1
            if ref[i] != hyp[j]:
                ops.append(("substitute", ref[i], hyp[j], i, j))
        else:
            j -= 1
            ops.append(("insert", None, hyp[j], None, j))
    return ops[::-1]


@F.pandas_udf(OPS)
def alignment(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Edit operations of (reference tokens, hypothesis tokens); none for an empty or NULL reference."""
    names = ("op", "ref_word", "hyp_word", "ref_idx", "hyp_idx")
    for refs, hyps in pairs:
        yield pd.Series([[dict(zip(names, x)) for x in align(list(r), list(h) if h is not None else [])] if r is not None and len(r) else [] for r, h in zip(refs, hyps)])
