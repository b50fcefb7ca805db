"""Text corpora that share no sentence with an evaluation set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import normalize


def sentences(rows: DataFrame, text: str) -> DataFrame:
    """(…, sent_pos, sentence): non-empty lines."""
    lines = rows.select("*", F.posexplode(F.split(text, r"\n")).alias("sent_pos", "line"))
    return lines.withColumn("sentence", F.trim("line")).filter("sentence <> ''").drop("line")


def _normalised(candidates: DataFrame) -> DataFrame:
    # a generator of one row: what follows reads the normalised text and doesn't repeat the work
    return candidates.select("*", F.explode(F.array(normalize(F.col("sentence")))).alias("norm")).withColumn("_n", F.when(F.col("norm") == "", 0).otherwise(F.length("norm") - F.length(F.replace(F.col("norm"), F.lit(" "), F.lit(""))) + 1))


def _excluded(evaluation: DataFrame) -> DataFrame:
    return evaluation.select(normalize(F.col("sentence")).alias("norm")).filter("norm <> ''").distinct()


def provenance(candidates: DataFrame, evaluation: DataFrame, source_order: str, min_words: int = 2) -> DataFrame:
    """(source, bucket, n): how many sentences are too_short, leakage, duplicate or kept, in this precedence.

    ``evaluation`` (sentence) is required: without one there is no guard. A duplicate is any but
    the first of equal normalised sentences. Sentences are counted by source before they are shuffled, so
    one that recurs very often is a row for each source; the first source has the one that is kept.
    """
    src = F.col(source_order)
    of = _normalised(candidates)
    short = F.col("_n") < min_words
    counts = of.groupBy(F.when(~short, F.col("norm")).alias("norm"), src.alias("src")).agg(F.count("*").alias("n"))
    by = counts.filter("norm IS NOT NULL").groupBy("norm").agg(F.collect_list(F.struct("src", "n")).alias("all"), F.min("src").alias("first"))  # an entry for each source
    by = by.join(_excluded(evaluation).withColumn("_x", F.lit(True)), "norm", "left")
    one = lambda bucket, n: F.struct(F.lit(bucket).alias("bucket"), n.alias("n"))
    rows = by.select(F.explode("all").alias("a"), F.col("first"), "_x").select("a.src", "a.n", "first", "_x")
    kept = F.when(F.col("src") == F.col("first"), 1).otherwise(0)
    split = F.when(F.col("_x"), F.array(one("leakage", F.col("n")))).otherwise(F.array(one("kept", kept.cast("long")), one("duplicate", F.col("n") - kept)))
    long = rows.select("src", F.explode(split).alias("b")).select("src", "b.*").filter("n > 0")
    all_ = long.unionByName(counts.filter("norm IS NULL").select("src", F.lit("too_short").alias("bucket"), "n"))
    return all_.groupBy(F.col("src").alias(source_order), "bucket").agg(F.sum("n").alias("n"))


def kept(candidates: DataFrame, evaluation: DataFrame, source_order: str, order: list[str], min_words: int = 2) -> DataFrame:
    """The kept sentences (norm, source and order): the first of each, by one ``min`` combined before the
    shuffle, without those of the evaluation set."""
    of = _normalised(candidates).filter(F.col("_n") >= min_words)
    first = of.groupBy("norm").agg(F.min(F.struct(source_order, *order)).alias("_first"))
    return first.join(_excluded(evaluation), "norm", "left_anti").select("_first.*", "norm")


def kept_texts(candidates: DataFrame, evaluation: DataFrame, min_words: int = 2) -> DataFrame:
    """(norm): the texts of ``kept``, which need no order; by one aggregate, in which an evaluation sentence is a mark."""
    of = _normalised(candidates).filter(F.col("_n") >= min_words).select("norm", F.lit(0).alias("_x"))
    both = of.unionByName(evaluation.select(normalize(F.col("sentence")).alias("norm"), F.lit(1).alias("_x")))
    return both.groupBy("norm").agg(F.max("_x").alias("_x")).filter("_x = 0").select("norm")


def leaked(corpus: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Normalised sentences that both hold; must be empty before a model is trained."""
    return corpus.select(normalize(F.col("sentence")).alias("norm")).intersect(evaluation.select(normalize(F.col("sentence")).alias("norm"))).filter("norm <> ''")


def assert_leakage_free(corpus: DataFrame, evaluation: DataFrame) -> None:
    found = leaked(corpus, evaluation).limit(1).collect()
    if found:
        raise ValueError(f"the corpus holds an evaluation sentence: {found[0].norm!r}")


def keep_first(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")
