"""Chunk plans and the emission of newly revealed words, for batches and for streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLACK = 0.02


def chunk_plan(rows: DataFrame, n: str, chunk: str, left: str) -> DataFrame:
    """Each row once a chunk: chunks of ``chunk`` follow one another over 0 .. n, the last is short;
    a chunk is decoded from ``left`` + ``chunk`` before its end."""
    of = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / F.col(chunk)) - 1)))
    end = F.least((F.col("chunk") + 1) * F.col(chunk), F.col(n))
    return of.withColumn("end_ms", end.cast("long")).withColumn("start_ms", F.greatest(F.lit(0), F.col("end_ms") - F.col(left) - F.col(chunk)).cast("long"))


def emitted_words(words: Column, chunk_ms: Column | None = None, n_ms: Column | None = None, slack: float = SLACK) -> Column:
    """Of words (w, start, end) those that a stream emits, in its order.

    A word is first heard whole in the chunk whose window ends no earlier than the word, less the slack; with
    ``chunk_ms`` words come by that chunk, and those that end after the recording's ``n_ms`` never
    come. It is emitted if it begins no earlier than the last end emitted, less the slack: since that only
    grows, a word that is refused once is refused in all later windows."""
    chunk = lambda w: F.greatest(F.lit(0), F.ceil((w["end"] - slack) * 1000 / chunk_ms) - 1) if chunk_ms is not None else F.lit(0)
    heard = words if n_ms is None else F.filter(words, lambda w: w["end"] <= n_ms / 1000 + slack)
    ordered = F.array_sort(F.transform(heard, lambda w: F.struct(chunk(w).cast("long").alias("chunk"), w["start"].alias("start"), w["end"].alias("end"), w["w"].alias("w"))))
    begin = F.struct(F.lit(0.0).alias("last"), F.slice(ordered, 1, 0).alias("kept"))
    step = lambda s, w: F.when(w["start"] >= s["last"] - slack, F.struct(F.greatest(s["last"], w["end"]).alias("last"), F.concat(s["kept"], F.array(w)).alias("kept"))).otherwise(s)
    return F.transform(F.aggregate(ordered, begin, step, lambda s: s["kept"]), lambda w: F.struct(w["w"].alias("w"), w["start"].alias("start"), w["end"].alias("end")))


def emit_stream(words: DataFrame, key: str = "utt_id", slack: float = SLACK, timeout_ms: int | None = 3_600_000) -> DataFrame:
    """The same on a stream of rows (key, win_end, start, end, w): a word is emitted if it begins no
    earlier than the key's last end and ends within its window. State is one number a key; it
    goes after ``timeout_ms`` without rows. None keeps it, for streams that end by themselves: with
    a timeout Spark waits for further rows.

    Rows of a key must arrive in order of their windows."""

    def run(name: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(batches)).sort_values(["win_end", "start", "end"])
        kept = []
        for r in rows.itertuples(index=False):
            if r.start >= last - slack and r.end <= r.win_end + slack:
                kept.append((name[0], r.w, r.start, r.end))
                last = max(last, r.end)
        state.update((last,))
        if timeout_ms is not None:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(kept, columns=[key, "w", "start", "end"])

    return words.groupBy(key).applyInPandasWithState(run, f"{key} string, w string, start double, end double", "last double", "append", "NoTimeout" if timeout_ms is None else "ProcessingTimeTimeout")


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Counts of events in sliding windows, for streams and batches; later events than ``late`` are dropped in streams."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def real_time_factor(proc_s: Column, audio_s: Column) -> Column:
    """Processing time by duration; 0 for an empty recording."""
    return F.when(audio_s != 0, proc_s / audio_s).otherwise(0.0)
