"""Tables of decoding results: selection, resumption, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.streaming.chunks import real_time_factor


def of_speakers(rows: DataFrame, speaker: str, wanted: list[str] | None = None, first: int | None = 6) -> DataFrame:
    """Rows of the wanted speakers; without a list those of the first by name, or with ``first`` None all."""
    if wanted is not None:
        return rows.filter(F.col(speaker).isin(wanted))
    if first is None:
        return rows
    names = rows.select(speaker).filter(F.col(speaker).isNotNull()).distinct().orderBy(speaker).limit(first)
    return rows.join(F.broadcast(names), speaker, "left_semi")  # ``first`` rows


def append_new(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Appends rows to a Parquet result table but those whose keys it holds already, so that a stopped run can
    be resumed. The first call makes the table."""
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        rows = rows.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    rows.write.mode("append").parquet(path)


def condition_summary(results: DataFrame) -> DataFrame:
    """Of results (condition, wer, cer, duration_s, proc_s, chunk_ms): means of both rates, of the real-time factor and of
    the processing time of a recording and of a chunk, and the algorithmic latency."""
    chunks = F.greatest(F.lit(1), F.ceil(F.col("duration_s") * 1000 / F.col("chunk_ms")))
    return results.groupBy("condition").agg(
        F.count("*").alias("n"), F.avg("wer").alias("mean_wer"), F.avg("cer").alias("mean_cer"), F.avg(real_time_factor(F.col("proc_s"), F.col("duration_s"))).alias("mean_rtf"), F.avg("proc_s").alias("mean_proc_s"),
        F.avg(F.col("proc_s") / F.when(F.col("chunk_ms").isNotNull(), chunks)).alias("mean_chunk_s"), F.max("chunk_ms").alias("latency_ms"),
    )
