"""Chunked and windowed processing in batch form, and round trips through the file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.spans import utterance_key
from lectern.plans.base import KEY, SPANS, U, hypotheses, query, utterances
from lectern.sources import files
from lectern.sources.tables import table
from lectern.storage import scratch
from lectern.streaming.chunks import chunk_plan as plan
from lectern.streaming.chunks import emitted_words

_CHUNKS = f"{U}, c AS (SELECT name, chunk_ms, left_ctx_ms FROM decode_conditions WHERE chunk_ms IS NOT NULL), x AS (SELECT utt_id, name AS condition, CAST(floor(duration_s * 1000) AS BIGINT) AS n, chunk_ms, left_ctx_ms FROM u, c WHERE duration_s > 0)"


@query(f"WITH {_CHUNKS} SELECT utt_id, condition, i AS chunk, greatest(0, least((i + 1) * chunk_ms, n) - left_ctx_ms - chunk_ms) AS start_ms, least((i + 1) * chunk_ms, n) AS end_ms FROM (SELECT *, unnest(generate_series(0, CAST(ceil(n / chunk_ms) AS BIGINT) - 1)) AS i FROM x WHERE n > 0)")
def chunk_plan(spark: SparkSession, d: str) -> DataFrame:
    """The windows in which each utterance is decoded under each streaming condition."""
    u = utterances(spark, d).filter("duration_s > 0").select("utt_id", F.floor(F.col("duration_s") * 1000).alias("n"))
    c = table(spark, d, "decode_conditions").filter("chunk_ms IS NOT NULL").select(F.col("name").alias("condition"), "chunk_ms", "left_ctx_ms")
    return plan(u.crossJoin(F.broadcast(c)).filter("n > 0"), "n", "chunk_ms", "left_ctx_ms").select("utt_id", "condition", "chunk", "start_ms", "end_ms")


@query("SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) // 1000000 AS start_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.unix_seconds(F.col("w.start").cast("timestamp")).alias("start_s"), "event_type", "n", "total")


@query("SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) // 1000000 - k * 3600 AS start_s, count(*) AS n FROM events, (SELECT unnest([0, 1, 2]) AS k) GROUP BY ALL")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of three hours, one each hour: a chunk with its left context."""
    e = table(spark, d, "events").groupBy(F.window("ts", "3 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return e.select(F.unix_seconds(F.col("w.start").cast("timestamp")).alias("start_s"), "n")


_WORDS = f"""{U}, {SPANS}, c AS (SELECT name AS condition, chunk_ms FROM decode_conditions WHERE chunk_ms IS NOT NULL),
w AS (SELECT utt_id, condition, chunk_ms, CAST(floor(duration_s * 1000) AS BIGINT) AS n, list_transform(list_filter(coalesce(phones, []), lambda x: x.xmin IS NOT NULL AND x.xmax IS NOT NULL), lambda x: {{'s': least(x.xmin, x.xmax), 'e': greatest(x.xmin, x.xmax)}}) AS words
  FROM u JOIN s ON s.key = {KEY.format('u.utt_id')}, c WHERE duration_s > 0),
o AS (SELECT utt_id, condition, len(words) AS n_words, list_sort(list_transform(list_filter(words, lambda x: x.e <= n / 1000 + 0.02), lambda x: {{'c': greatest(0, CAST(ceil((x.e - 0.02) * 1000 / chunk_ms) AS BIGINT) - 1), 's': x.s, 'e': x.e, 'last': 0.0::DOUBLE, 'k': 0::BIGINT}})) AS words FROM w),
z AS (SELECT utt_id, condition, n_words, list_reduce(list_prepend({{'c': 0::BIGINT, 's': 0.0::DOUBLE, 'e': 0.0::DOUBLE, 'last': 0.0::DOUBLE, 'k': 0::BIGINT}}, words), lambda a, x: CASE WHEN x.s >= a.last - 0.02 THEN {{'c': x.c, 's': x.s, 'e': x.e, 'last': greatest(a.last, x.e), 'k': a.k + 1}} ELSE a END) AS z FROM o)"""


@query(f"WITH {_WORDS} SELECT utt_id, condition, n_words, z.k AS n_emitted FROM z")
def emission_fold(spark: SparkSession, d: str) -> DataFrame:
    """Of the phones of each utterance, taken as words, those that a stream emits under each condition."""
    p = table(spark, d, "phone_annotations").filter("utt_id IS NOT NULL").groupBy(utterance_key(F.col("utt_id")).alias("key")).agg(F.array_distinct(F.flatten(F.collect_list("phones"))).alias("phones"))
    both = F.filter(F.coalesce("phones", F.array()), lambda x: x["xmin"].isNotNull() & x["xmax"].isNotNull())
    words = F.transform(both, lambda x: F.struct(x["canonical"].alias("w"), F.least(x["xmin"], x["xmax"]).alias("start"), F.greatest(x["xmin"], x["xmax"]).alias("end")))
    c = table(spark, d, "decode_conditions").filter("chunk_ms IS NOT NULL").select(F.col("name").alias("condition"), "chunk_ms")
    u = utterances(spark, d).filter("duration_s > 0").select("utt_id", utterance_key(F.col("utt_id")).alias("key"), F.floor(F.col("duration_s") * 1000).alias("n"))
    of = u.join(p, "key").withColumn("words", words).crossJoin(F.broadcast(c))  # the conditions are a fixed handful
    return of.select("utt_id", "condition", F.size("words").cast("long").alias("n_words"), F.size(emitted_words(F.col("words"), F.col("chunk_ms"), F.col("n"))).cast("long").alias("n_emitted"))


@query(f"WITH {U} SELECT utt_id, dataset, wav_path, text, duration_s, speaker, accent, cefr, CASE WHEN extra IS NOT NULL THEN array_to_string(list_sort(list_transform(map_entries(extra), lambda e: e.key || '=' || coalesce(e.value, 'null'))), ';') END AS extra FROM u")
def manifest_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The manifest written as JSON lines and read with its schema."""
    path = scratch(spark, "manifest")
    files.write_manifest(utterances(spark, d), path)
    pairs = F.array_sort(F.transform(F.map_entries("extra"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))))
    return files.read_manifest(spark, path).withColumn("extra", F.array_join(pairs, ";")).select("utt_id", "dataset", "wav_path", "text", "duration_s", "speaker", "accent", "cefr", "extra")


@query("SELECT error_id, op, ref_word, hyp_word, CASE WHEN NOT isnan(approx_time_s) THEN approx_time_s END AS approx_time_s, coalesce(isnan(approx_time_s), false) AS is_nan FROM error_rows GROUP BY ALL")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Error rows written as CSV and read with an explicit schema: the words null and nan stay words. Times that are no number come out as a flag."""
    path = scratch(spark, "errors")
    rows = table(spark, d, "error_rows").select("error_id", "op", "ref_word", "hyp_word", "approx_time_s").distinct()
    files.write_csv(rows, path)
    back = files.read_csv(spark, path, "error_id long, op string, ref_word string, hyp_word string, approx_time_s double")
    nan = F.coalesce(F.isnan("approx_time_s") & F.col("approx_time_s").isNotNull(), F.lit(False))
    return back.select("error_id", "op", "ref_word", "hyp_word", F.when(~nan, F.col("approx_time_s")).alias("approx_time_s"), nan.alias("is_nan"))


@query(
    "WITH h AS (SELECT DISTINCT * FROM hypotheses WHERE text IS NOT NULL AND acoustic_score IS NOT NULL), r AS (SELECT utt_id, row_number() OVER (PARTITION BY utt_id ORDER BY hyp_pos, hyp_id) - 1 AS pos, text, acoustic_score FROM h) SELECT utt_id, pos, text, acoustic_score FROM r"
)
def nbest_cache_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """N-best lists written as a cache of JSON lines and read again; of repeated ids the last line wins."""
    path = scratch(spark, "nbest")
    h = hypotheses(spark, d).filter("text IS NOT NULL AND acoustic_score IS NOT NULL")
    files.write_nbest_cache(h.select("utt_id", F.col("hyp_pos").alias("pos"), "hyp_id", "text", F.col("acoustic_score").alias("acoustic")), path)
    return files.read_nbest_cache(spark, path).select("utt_id", F.explode("hyps").alias("h")).select("utt_id", F.col("h.pos").cast("long").alias("pos"), "h.text", F.col("h.acoustic").alias("acoustic_score"))


@query(f"WITH {SPANS} SELECT key AS utt_id, count(*) AS n_phones FROM (SELECT key, unnest(phones) AS x FROM s) GROUP BY key")
def phones_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Annotations, one line an utterance, written as JSON lines and read again."""
    path = scratch(spark, "phones")
    p = table(spark, d, "phone_annotations").filter("utt_id IS NOT NULL").groupBy(utterance_key(F.col("utt_id")).alias("utt_id")).agg(F.array_distinct(F.flatten(F.collect_list("phones"))).alias("phones"))
    files.write_phones(p, path)
    return files.read_phones(spark, path).filter(F.size("phones") > 0).select("utt_id", F.size("phones").cast("long").alias("n_phones"))
