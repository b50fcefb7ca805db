"""Errors and annotated time spans of the same utterance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utterance_key(utt_id: Column) -> Column:
    """Annotations and logs write ids in either case and with blanks or tabs around them."""
    return F.lower(F.trim(utt_id, F.lit(" \t")))


def span_label(span: Column) -> Column:
    """canonical>perceived(type); NULL without a span."""
    text = lambda c: F.coalesce(span[c], F.lit(""))
    return F.when(span.isNotNull(), F.concat(text("canonical"), F.lit(">"), text("perceived"), F.lit("("), text("err_type"), F.lit(")")))


def nearest_span(time: Column, spans: Column, tolerance: float) -> Column:
    """struct(d, i) of the nearest span: d is 0 within the span widened by the tolerance, else the
    distance to the nearer edge of the span itself; the first of equals. NULL without spans.

    It works within the row, so no span is shuffled a second time."""
    t = time
    distance = lambda s: F.when((t >= s["xmin"] - tolerance) & (t <= s["xmax"] + tolerance), 0.0).otherwise(F.least(F.abs(t - s["xmin"]), F.abs(t - s["xmax"])))
    return F.array_min(F.transform(spans, lambda s, i: F.struct(distance(s).alias("d"), i.alias("i"))))
