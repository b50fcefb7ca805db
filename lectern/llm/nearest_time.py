"""P4: pair records with the nearest span in time of the same entity, by tick expansion.

1. Each span is exploded to the ticks (cells of ``tick`` seconds) that its reach, the span widened
   by the tolerance, touches.
2. Per entity and tick only spans that are nearest somewhere in the tick are kept. Of spans that
   end before the tick only the last end matters, of spans that start after it only the first
   start, of spans that start at one place within it only the longest: three mergeable
   aggregates, combined before the shuffle. With timestamps of resolution r at most
   ``tick / r + 2`` spans are left in a tick however many there were.
3. Left records are put on their own tick and meet it by an equi-join on (entity, tick). The exact
   distance then decides among the tick's few spans.

The equi-join key holds the tick, so an entity with very many records is spread over its ticks;
AQE splits what is still skewed.

Defined results: entities match without case and outer blanks and tabs; NULL entities never match;
left times must be numbers >= 0; spans need both ends (NaN counts as missing), swapped ends are
put in order; the distance is 0 inside the span (ends included), else that to the nearer end, and
must be at most the tolerance; ties go to the later end, then the earlier start, then the smaller
span id. Repeated left ids count once (with their nearest pair), repeated spans change nothing. An empty table gives
an empty result. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-9


def entity(name: Column) -> Column:
    return F.lower(F.trim(name, F.lit(" \t")))


def mispronounced(annotations: DataFrame) -> DataFrame:
    """(entity, span_id, lo, hi, label) of the phones marked s, d or a that have both ends."""
    p = annotations.filter("phones IS NOT NULL").select(entity(F.col("utt_id")).alias("entity"), F.explode("phones").alias("p"))
    kind = F.lower(F.regexp_replace("p.err_type", r"^\s+|\s+$", ""))
    return (
        p.filter(kind.isin("s", "d", "a"))
        .filter("entity IS NOT NULL AND p.xmin IS NOT NULL AND p.xmax IS NOT NULL AND NOT isnan(p.xmin) AND NOT isnan(p.xmax)")
        .select("entity", F.col("p.phone_id").alias("span_id"), F.least("p.xmin", "p.xmax").alias("lo"), F.greatest("p.xmin", "p.xmax").alias("hi"))
    )


def tick_candidates(spans: DataFrame, tolerance: float, tick: float) -> DataFrame:
    """(entity, tick, spans array<struct<lo, hi, span_id>>): the spans that can be nearest in a tick."""
    cell = lambda x: F.floor(x / tick)
    far = tolerance + EPSILON
    ticks = spans.select("entity", "span_id", "lo", "hi", F.explode(F.sequence(F.greatest(cell(F.col("lo") - far), F.lit(0)), F.greatest(cell(F.col("hi") + far), F.lit(0)))).alias("tick"))
    begin, end = F.col("tick") * tick - EPSILON, (F.col("tick") + 1) * tick + EPSILON
    # one key for all spans that start before the tick, one for all that start after it
    start = F.when(F.col("lo") < begin, -1.0).when(F.col("lo") > end, -2.0).otherwise(F.col("lo"))
    ticks = ticks.withColumn("start", start)
    # the order that decides: the longest span, or the first start; then the tie rule
    late = F.col("start") == -2.0
    rank = F.struct(F.when(late, F.col("lo")).otherwise(-F.col("hi")).alias("k"), F.when(late, -F.col("hi")).otherwise(F.col("lo")).alias("then"), F.col("span_id").alias("span_id"), F.col("lo").alias("lo"), F.col("hi").alias("hi"))
    best = ticks.groupBy("entity", "tick", "start").agg(F.min(rank).alias("b"))
    return best.groupBy("entity", "tick").agg(F.collect_list(F.struct(F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"), F.col("b.span_id").alias("span_id"))).alias("spans"))


def nearest_spans(left: DataFrame, spans: DataFrame, tolerance: float = 0.15, tick: float = 0.25) -> DataFrame:
    """(left_id, span_id, distance) for left (left_id, entity, t) and spans (entity, span_id, lo, hi)."""
    candidates = tick_candidates(spans, tolerance, tick)
    left = left.filter("entity IS NOT NULL AND t >= 0 AND NOT isnan(t) AND t < double('Infinity')").withColumn("tick", F.floor(F.col("t") / tick))
    distance = lambda s: F.greatest(F.lit(0.0), s["lo"] - F.col("t"), F.col("t") - s["hi"])
    scored = left.join(candidates, ["entity", "tick"]).select(
        "left_id",
        F.array_min(F.transform("spans", lambda s: F.struct(distance(s).alias("d"), (-s["hi"]).alias("end"), s["lo"].alias("lo"), s["span_id"].alias("span_id")))).alias("m"),
    )
    within = scored.filter(F.col("m.d") <= tolerance + EPSILON).select("left_id", F.col("m.span_id").alias("span_id"), F.col("m.d").alias("distance"))
    return within.groupBy("left_id").agg(F.min_by("span_id", F.struct("distance", "span_id")).alias("span_id"), F.min("distance").alias("distance"))


def error_phone_pairs(errors: DataFrame, annotations: DataFrame, tolerance: float = 0.15, tick: float = 0.25) -> DataFrame:
    """(error_id, phone_id, distance)."""
    left = errors.select(F.col("error_id").alias("left_id"), entity(F.col("utt_id")).alias("entity"), F.col("approx_time_s").alias("t")).filter("left_id IS NOT NULL")
    pairs = nearest_spans(left, mispronounced(annotations), tolerance, tick)
    return pairs.select(F.col("left_id").alias("error_id"), F.col("span_id").alias("phone_id"), "distance")
