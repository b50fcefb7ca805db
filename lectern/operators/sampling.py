"""Splits, subsets, stratified samples and bootstrap draws, all decided by hashes.

``hash_key`` is an md5 that any engine can repeat; nothing depends on row order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_key(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts]))


def hash_int(*parts: Column | str) -> Column:
    """The first eight hexadecimal digits of the md5 as a number."""
    return F.conv(F.substring(hash_key(*parts), 1, 8), 16, 10).cast("long")


def first_by_hash(rows: DataFrame, key: str, seed: str, count: int | None = None, share: float | None = None) -> DataFrame:
    """Adds ``chosen``: whether the row is among the first in hash order, by number or by share
    (at least one). Exact without a global sort: counts of 4096 hash buckets (one small
    aggregate) tell which bucket holds the border, and only that one is ranked.
    """
    h = rows.withColumn("_h", hash_key(F.lit(seed), F.col(key))).withColumn("_b", F.substring("_h", 1, 3))
    sizes = sorted((r["_b"], r["count"]) for r in h.groupBy("_b").count().collect())
    total = sum(n for _, n in sizes)
    wanted = count if share is None else max(1, int(total * share))
    border, before = "g", 0  # 'g' is beyond all hexadecimal digits
    for (b, n), until in zip(sizes, accumulate(n for _, n in sizes)):
        if until > wanted:
            border, before = b, until - n
            break
    at_border = h.filter(F.col("_b") == border).withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))).withColumn("chosen", F.col("_r") <= wanted - before).drop("_r")
    others = h.filter(F.col("_b") != border).withColumn("chosen", F.col("_b") < border)
    return others.unionByName(at_border).drop("_h", "_b")


def cap_per_group(rows: DataFrame, group: str, order: list[str], cap: int) -> DataFrame:
    """The first ``cap`` rows of each group; Spark limits groups before the shuffle too."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_r") <= cap).drop("_r")


def allocate(sizes: dict, n: int, floor: int = 4) -> dict:
    """How many to draw of each stratum: a floor, then one by one where most is left; ties by name."""
    drawn = {s: min(c, floor) for s, c in sizes.items()}
    while sum(drawn.values()) < n:
        s = max(sorted(sizes), key=lambda s: sizes[s] - drawn[s])
        if sizes[s] <= drawn[s]:
            break
        drawn[s] += 1
    return drawn


def stratified_sample(rows: DataFrame, stratum: str, key: str, n: int, seed: str, floor: int = 4) -> DataFrame:
    """A stratified sample in hash order; NULL is a stratum of its own, named ''."""
    named = rows.withColumn("_s", F.coalesce(F.col(stratum).cast("string"), F.lit("")))
    drawn = allocate({r["_s"]: r["count"] for r in named.groupBy("_s").count().collect()}, n, floor)
    if not drawn:
        return rows
    most = F.create_map(*[F.lit(x) for p in drawn.items() for x in p])[F.col("_s")]
    rank = F.row_number().over(Window.partitionBy("_s").orderBy(hash_key(F.lit(seed), F.col(key).cast("string"))))
    return named.withColumn("_r", rank).filter((F.col("_r") <= max(drawn.values())) & (F.col("_r") <= most)).drop("_s", "_r")


_2_32 = 1 << 32


def mixed(x):
    """A number below 2**32 from one below 2**62, for numpy arrays; SQL repeats it with %, xor and >>."""
    v = x % _2_32
    v = (v ^ (v >> 16)) * 73244475 % _2_32
    v = (v ^ (v >> 15)) * 295559667 % _2_32
    return v ^ (v >> 16)


UNIT_STEP, DRAW_STEP = 2246822519, 2654435761
#: Of a Poisson variable of mean 1: 2**32 times the probability of at most 0, 1, .. 8.
POISSON = [int(_2_32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(9)]
_SUMS = "b long, n double, eb double, ea double"


def _rates(sums: DataFrame) -> DataFrame:
    return sums.select("b", (F.col("eb") / F.col("n")).alias("wer_baseline"), (F.col("ea") / F.col("n")).alias("wer_adapted"), ((F.col("ea") - F.col("eb")) / F.col("n")).alias("delta"))


def bootstrap(units: DataFrame, key: str, n_boot: int = 10_000, seed: int = 1234, max_units: int = 1_000_000) -> DataFrame:
    """(b, wer_baseline, wer_adapted, delta): paired draws with replacement of as many units as there are, from
    units with sums (n_ref, e_base, e_adapt): for a cluster bootstrap one row a cluster.

    The i-th unit of draw b is ``mixed(seed + i * UNIT_STEP + b * DRAW_STEP) mod n`` in the order of ``key``.
    Draws are dealt over tasks, which hold all units: three numbers for each of at most ``max_units``
    (ValueError beyond; ``poisson_bootstrap`` has no such bound).
    """
    spark = units.sparkSession
    rows = units.select(key, "n_ref", "e_base", "e_adapt").orderBy(key).limit(max_units + 1).toPandas()
    if len(rows) > max_units:
        raise ValueError(f"more than {max_units} units: use poisson_bootstrap")
    table = spark.sparkContext.broadcast(rows[["n_ref", "e_base", "e_adapt"]].to_numpy(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = table.value
        place = seed + np.arange(len(x), dtype=np.int64) * UNIT_STEP % _2_32
        for batch in batches:
            bs = batch.column(0).to_numpy()
            sums = np.array([x[mixed(place + b * DRAW_STEP) % len(x)].sum(0) for b in bs]).reshape(-1, 3) if len(x) else np.zeros((0, 3))
            yield pa.RecordBatch.from_arrays([pa.array(bs[: len(sums)]), *[pa.array(sums[:, c]) for c in range(3)]], names=["b", "n", "eb", "ea"])

    return _rates(spark.range(n_boot).mapInArrow(run, _SUMS))


def poisson_bootstrap(units: DataFrame, key: str, n_boot: int = 10_000, seed: str = "1234") -> DataFrame:
    """The same for any number of units, in one pass: each unit takes part in each draw as often as a
    Poisson variable of mean 1 tells, whose value hangs on the hash of its key and the draw alone. A task sends one
    row of sums a draw; no unit is shuffled."""
    rows = units.select(hash_int(F.lit(seed), F.col(key)).alias("h"), *[F.col(c).cast("double") for c in ("n_ref", "e_base", "e_adapt")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((n_boot, 3))
        steps = np.arange(n_boot, dtype=np.int64) * DRAW_STEP
        bounds = np.array(POISSON)
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy() for c in (1, 2, 3)], 1)
            h = batch.column(0).to_numpy()
            for a in range(0, len(h), 256):
                u = mixed(h[a : a + 256, None] + steps)
                sums += np.searchsorted(bounds, u, side="right").T @ x[a : a + 256]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_boot)), *[pa.array(sums[:, c]) for c in range(3)]], names=["b", "n", "eb", "ea"])

    sums = rows.mapInArrow(run, _SUMS).groupBy("b").agg(*[F.sum(c).alias(c) for c in ("n", "eb", "ea")])
    return _rates(sums.filter("n > 0"))


def nearest_rank(value: str, share: float, n: int) -> Column:
    """The value at 0-based place int(share * n) of ``n`` sorted draws."""
    return F.element_at(F.array_sort(F.collect_list(value)), int(share * n) + 1)


def significance(draws: DataFrame, n_boot: int) -> DataFrame:
    """One row: intervals (nearest rank), one-sided p and whether the adapted system is better."""
    ends = [nearest_rank(c, s, n_boot).alias(f"{c}_{e}") for c in ("wer_baseline", "wer_adapted", "delta") for e, s in (("lo", 0.025), ("hi", 0.975))]
    return draws.agg(*ends, F.avg((F.col("delta") >= 0).cast("double")).alias("p")).withColumn("significant", (F.col("p") < 0.05) & (F.col("delta_hi") < 0))
