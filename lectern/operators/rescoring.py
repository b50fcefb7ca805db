"""N-best lists: picks by combined score, weight search, oracle bounds.

Lists are rows (utt_id, pos, text, acoustic, lm, edits, n_ref); pos decides ties. Picks are one
``max_by`` or ``min_by`` aggregate a list, combined before the shuffle, never a sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def combined(weight: Column | float) -> Column:
    return F.col("acoustic") + weight * F.col("lm")


def pick(column: str, score: Column) -> Column:
    """The column of the row with the highest score; the first of equals."""
    return F.max_by(F.col(column), F.struct(score.alias("s"), (-F.col("pos")).alias("p")))


def rescored(nbest: DataFrame, weight: float, *carried: str) -> DataFrame:
    """Baseline (weight 0) and adapted picks of each list, side by side, in one pass; with ``carried`` columns of the list."""
    both = [pick(c, s).alias(f"{c}_{name}") for name, s in (("baseline", combined(0.0)), ("adapted", combined(weight))) for c in ("text", "edits")]
    return nbest.groupBy("utt_id").agg(*both, F.first("n_ref").alias("n_ref"), *[F.first(c).alias(c) for c in carried]).withColumn("changed", ~F.col("text_baseline").eqNullSafe(F.col("text_adapted")))


def weight_sweep(nbest: DataFrame, grid: list[float]) -> DataFrame:
    """(grid_pos, weight, wer): micro word error rate of the picks at each weight; each list is shuffled once."""
    picks = nbest.groupBy("utt_id").agg(F.first("n_ref").alias("n_ref"), *[pick("edits", combined(w)).alias(f"e{i}") for i, w in enumerate(grid)])
    sums = picks.filter("n_ref > 0").agg(F.sum("n_ref").alias("n"), *[F.sum(f"e{i}").alias(f"e{i}") for i in range(len(grid))])
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("grid_pos"), F.lit(float(w)).alias("weight"), (F.col(f"e{i}") / F.col("n")).alias("wer")) for i, w in enumerate(grid)]))
    return sums.select(rows.alias("r")).select("r.*")


def best_weight(sweep: DataFrame) -> Column:
    """The weight of the lowest error; ties go to the earlier grid entry."""
    return F.min_by("weight", F.struct("wer", "grid_pos"))


def oracle_by_depth(nbest: DataFrame, depths: list[int]) -> DataFrame:
    """(depth, wer): micro error of the best hypothesis among the ``depth`` of highest acoustic score."""
    ranked = nbest.filter("n_ref > 0").withColumn("rank", F.row_number().over(Window.partitionBy("utt_id").orderBy(F.desc("acoustic"), "pos")))
    best = ranked.groupBy("utt_id").agg(F.first("n_ref").alias("n_ref"), *[F.min(F.when(F.col("rank") <= d, F.col("edits"))).alias(f"e{d}") for d in depths])
    sums = best.agg(F.sum("n_ref").alias("n"), *[F.sum(f"e{d}").alias(f"e{d}") for d in depths])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), (F.col(f"e{d}") / F.col("n")).alias("wer")) for d in depths])).alias("r")).select("r.*")


def headroom(baseline: Column, adapted: Column, oracle: Column) -> tuple[Column, Column]:
    """(head-room in percent of the baseline, share of it that the adapted system takes); NULL unless there is some."""
    room = baseline - oracle
    return F.when(room > 0, 100 * F.try_divide(room, baseline)), F.when(room > 0, (baseline - adapted) / room)


def rank_movement(nbest: DataFrame, weight: float) -> DataFrame:
    """Each hypothesis' rank by acoustic and by combined score."""
    rank = lambda s: F.row_number().over(Window.partitionBy("utt_id").orderBy(F.desc(s), "pos"))
    return nbest.select("utt_id", "pos", rank(F.col("acoustic")).alias("rank_acoustic"), rank(combined(weight)).alias("rank_combined"))
