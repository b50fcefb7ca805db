"""Queries over references and hypotheses: normalisation, error rates, conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.distance import alignment, cer
from lectern.functions.text import normalize, tokens
from lectern.operators.errors import error_rows, with_error_time, with_word_time
from lectern.operators.results import append_new, of_speakers
from lectern.operators.results import condition_summary as summarised
from lectern.operators.sampling import hash_int
from lectern.plans.base import E, H, PAIRS, U, errors, hypotheses, md5_int, norm, query, toks, top_pairs, utterances
from lectern.sources.tables import table
from lectern.storage import scratch


@query(f"WITH {U} SELECT utt_id, {norm('text')} AS norm, len({toks('text')}) AS n_words FROM u WHERE text IS NOT NULL")
def normalize_texts(spark: SparkSession, d: str) -> DataFrame:
    u = utterances(spark, d).filter("text IS NOT NULL")
    return u.select("utt_id", normalize(F.col("text")).alias("norm"), F.size(tokens(F.col("text"))).alias("n_words"))


@query(f"SELECT doc_id, len({toks('text')}) AS n_tokens FROM documents WHERE text IS NOT NULL")
def document_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.size(tokens(F.col("text"))).alias("n_tokens"))


@query(f"WITH {U} SELECT utt_id, dataset, duration_s FROM u WHERE duration_s >= 2.0 AND duration_s <= 30.0 AND trim(text) <> '' AND len({toks('text')}) >= 2")
def filtered_utterances(spark: SparkSession, d: str) -> DataFrame:
    """Minimum duration, duration range, non-empty text, minimum words."""
    u = utterances(spark, d).filter(F.col("duration_s").between(2.0, 30.0) & (F.trim("text") != ""))
    return u.filter(F.size(tokens(F.col("text"))) >= 2).select("utt_id", "dataset", "duration_s")


@query("SELECT DISTINCT utt_id, CASE WHEN len(string_split(utt_id, '_')) >= 3 AND starts_with(utt_id, 'l2arctic') THEN string_split(utt_id, '_')[2] ELSE utt_id END AS cluster FROM utterances WHERE utt_id IS NOT NULL")
def cluster_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "utterances").filter("utt_id IS NOT NULL").select("utt_id", cluster_key().alias("cluster")).distinct()


def cluster_key():
    parts = F.split("utt_id", "_")
    return F.when((F.size(parts) >= 3) & F.col("utt_id").startswith("l2arctic"), F.get(parts, F.lit(1))).otherwise(F.col("utt_id"))


@query(
    "WITH c AS (SELECT DISTINCT utt_id, CASE WHEN len(string_split(utt_id, '_')) >= 3 AND starts_with(utt_id, 'l2arctic') THEN string_split(utt_id, '_')[2] END AS s FROM utterances WHERE utt_id IS NOT NULL) SELECT utt_id, s AS speaker FROM c WHERE s IN (SELECT DISTINCT s FROM c WHERE s IS NOT NULL ORDER BY s LIMIT 6)"
)
def selected_speakers(spark: SparkSession, d: str) -> DataFrame:
    """The utterances of the first six speakers by name."""
    u = table(spark, d, "utterances").filter("utt_id IS NOT NULL").select("utt_id", cluster_key().alias("speaker")).filter("speaker <> utt_id").distinct()
    return of_speakers(u, "speaker")


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def dimension_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Left lookups in small dimensions; unknown keys give NULL."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select("c_custkey", "n_name", "r_name")


@query(f"WITH {PAIRS} SELECT hyp_id, utt_id, n_ref, n_hyp, edits, CASE WHEN n_ref > 0 THEN round(edits / n_ref, 6) END AS wer FROM p WHERE pos = 0")
def pair_wer(spark: SparkSession, d: str) -> DataFrame:
    return top_pairs(spark, d).select("hyp_id", "utt_id", "n_ref", "n_hyp", "edits", F.round("wer", 6).alias("wer"))


_CHARS = "array_to_string(list_transform(string_split({}, ''), lambda t: chr(CAST(list_position(list_distinct(list_concat(string_split(r, ''), string_split(hy, ''))), t) AS INTEGER))), '')"


@query(
    f"WITH {PAIRS}, c AS (SELECT hyp_id, array_to_string(ref, ' ') AS r, array_to_string(hyp, ' ') AS hy FROM p WHERE pos = 0) "
    f"SELECT hyp_id, CASE WHEN r <> '' THEN round(CASE WHEN hy = '' THEN length(r) ELSE levenshtein({_CHARS.format('r')}, {_CHARS.format('hy')}) END / length(r), 6) END AS cer FROM c"
)
def pair_cer(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: F.array_join(c, " ")
    return top_pairs(spark, d).select("hyp_id", F.round(cer(text("ref"), text("hyp")), 6).alias("cer"))


@query(
    f"WITH {PAIRS}, c AS (SELECT dataset, array_to_string(ref, ' ') AS r, array_to_string(hyp, ' ') AS hy FROM p WHERE pos = 0) "
    f"SELECT dataset, CAST(sum(length(r)) AS BIGINT) AS n_chars, round(sum(CASE WHEN hy = '' THEN length(r) ELSE levenshtein({_CHARS.format('r')}, {_CHARS.format('hy')}) END) / sum(length(r)), 6) AS cer FROM c WHERE r <> '' GROUP BY ALL"
)
def corpus_cer(spark: SparkSession, d: str) -> DataFrame:
    """Micro character error rate: sums over pairs with a reference, then one division."""
    text = lambda c: F.array_join(c, " ")
    p = top_pairs(spark, d).select("dataset", text("ref").alias("r"), text("hyp").alias("h")).filter("r <> ''")
    chars = F.sum(F.length("r"))
    return p.groupBy("dataset").agg(chars.alias("n_chars"), F.round(F.sum(F.levenshtein("r", "h")) / chars, 6).alias("cer"))


_MICRO = "count(*) AS n, CAST(sum(edits) AS BIGINT) AS n_edits, CAST(sum(n_ref) AS BIGINT) AS n_words, round(sum(edits) / sum(n_ref), 6) AS wer"


def micro() -> list:
    return [F.count("*").alias("n"), F.sum("edits").alias("n_edits"), F.sum("n_ref").alias("n_words"), F.round(F.sum("edits") / F.sum("n_ref"), 6).alias("wer")]


@query(f"WITH {PAIRS} SELECT coalesce(accent, 'unknown') AS accent, {_MICRO} FROM p WHERE pos = 0 AND n_ref > 0 GROUP BY ALL")
def corpus_wer_by_accent(spark: SparkSession, d: str) -> DataFrame:
    """Micro error rate: sums over pairs with a reference, then one division."""
    return top_pairs(spark, d).filter("n_ref > 0").groupBy(F.coalesce("accent", F.lit("unknown")).alias("accent")).agg(*micro())


@query(f"WITH {PAIRS} SELECT dataset, round(avg(edits / n_ref), 6) AS macro_wer, round(sum(edits) / sum(n_ref), 6) AS micro_wer FROM p WHERE pos = 0 AND n_ref > 0 GROUP BY ALL")
def macro_vs_micro_wer(spark: SparkSession, d: str) -> DataFrame:
    return top_pairs(spark, d).filter("n_ref > 0").groupBy("dataset").agg(F.round(F.avg("wer"), 6).alias("macro_wer"), F.round(F.sum("edits") / F.sum("n_ref"), 6).alias("micro_wer"))


@query(f"WITH {PAIRS} SELECT hyp_id, edits, n_hyp - n_ref AS insertions_less_deletions FROM p WHERE pos = 0 AND n_ref > 0")
def alignment_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Each alignment has as many operations as the edit distance, and accounts for the lengths."""
    ops = top_pairs(spark, d).filter("n_ref > 0").select("hyp_id", alignment(F.col("ref"), F.col("hyp")).alias("ops"))
    n = lambda op: F.size(F.filter("ops", lambda o: o["op"] == op))
    return ops.select("hyp_id", F.size("ops").alias("edits"), (n("insert") - n("delete")).alias("insertions_less_deletions"))


@query()
def aligned_error_rows(spark: SparkSession, d: str) -> DataFrame:
    """Error rows derived from the aligned best hypotheses. Their time is the start of the hypothesis word, which
    stands for a quarter of a second here, or for deletions that of the error before."""
    pairs = top_pairs(spark, d).withColumn("words", F.transform(F.split("text", " "), lambda w, i: F.struct(w.alias("w"), (i * 0.25).alias("start"))))
    rows = with_word_time(error_rows(pairs.select("hyp_id", "utt_id", "ref", "hyp", "words")), "words")
    timed = with_error_time(rows, ["hyp_id"], ["align_pos"], "word_time_s")
    return timed.select("hyp_id", "utt_id", "align_pos", "op", "ref_word", "hyp_word", "ref_idx", "hyp_idx", "ref_context", "time_s")


@query()
def aligned_error_mix(spark: SparkSession, d: str) -> DataFrame:
    """Substitutions, deletions and insertions of each utterance's best hypothesis."""
    rows = aligned_error_rows(spark, d)
    return rows.groupBy("utt_id").agg(*[F.count_if(F.col("op") == o).alias(f"n_{o}") for o in ("substitute", "delete", "insert")])


_UTT_COND = f"""{U}, {E}, x AS (SELECT utt_id, c.name AS condition, c.mode, c.chunk_ms, len({toks('text')}) AS n_ref FROM u CROSS JOIN decode_conditions c),
n AS (SELECT utt_id, condition, count(*) FILTER (op = 'substitute') AS s, count(*) FILTER (op = 'delete') AS dl, count(*) FILTER (op = 'insert') AS i FROM e GROUP BY ALL),
r AS (SELECT x.*, coalesce(s, 0) AS s, coalesce(dl, 0) AS dl, coalesce(i, 0) AS i, CASE WHEN n_ref > 0 THEN (coalesce(s, 0) + coalesce(dl, 0) + coalesce(i, 0)) / n_ref END AS wer FROM x LEFT JOIN n USING (utt_id, condition))"""


def results(spark: SparkSession, d: str) -> DataFrame:
    """One row for each utterance and condition, with its error counts from the log."""
    u = utterances(spark, d).select("utt_id", F.size(tokens(F.col("text"))).alias("n_ref"))
    c = table(spark, d, "decode_conditions").select(F.col("name").alias("condition"), "mode", "chunk_ms")
    x = u.crossJoin(F.broadcast(c))  # the conditions are a fixed handful
    n = errors(spark, d).groupBy("utt_id", "condition").agg(*[F.count_if(F.col("op") == o).alias(a) for o, a in (("substitute", "s"), ("delete", "dl"), ("insert", "i"))])
    r = x.join(n, ["utt_id", "condition"], "left").na.fill(0, ["s", "dl", "i"])
    return r.withColumn("wer", F.when(F.col("n_ref") > 0, (F.col("s") + F.col("dl") + F.col("i")) / F.col("n_ref")))


@query(f"WITH {_UTT_COND} SELECT condition, max(chunk_ms) AS latency_ms, count(utt_id) AS n, round(avg(wer), 6) AS mean_wer FROM r GROUP BY condition ORDER BY latency_ms NULLS FIRST")
def condition_summary(spark: SparkSession, d: str) -> DataFrame:
    by = results(spark, d).groupBy("condition").agg(F.max("chunk_ms").alias("latency_ms"), F.count("utt_id").alias("n"), F.round(F.avg("wer"), 6).alias("mean_wer"))
    return by.orderBy(F.asc_nulls_first("latency_ms"))


_PROC = "duration_s * (" + md5_int("utt_id || '|' || condition") + " % 1000) / 1000"
_SENT = f"""{_UTT_COND}, l AS (SELECT utt_id, condition, arg_min({norm('ref_sentence')}, error_id) AS r, arg_min({norm('hyp_sentence')}, error_id) AS hy FROM e GROUP BY ALL),
ce AS (SELECT utt_id, condition, CASE WHEN r <> '' THEN (CASE WHEN hy = '' THEN length(r) ELSE levenshtein({_CHARS.format('r')}, {_CHARS.format('hy')}) END) / length(r) END AS cer FROM l),
rs AS (SELECT r.*, duration_s, {_PROC} AS proc_s, CASE WHEN ce.utt_id IS NULL THEN (CASE WHEN n_ref > 0 THEN 0.0 END) ELSE cer END AS cer FROM r JOIN u USING (utt_id) LEFT JOIN ce USING (utt_id, condition))"""


def decoding_results(spark: SparkSession, d: str) -> DataFrame:
    """Results with both rates and times. The log has sentences of utterances with errors only, the others' rate is
    0; the tables hold no processing times: a hash of the key stands for the share of the duration."""
    sentences = errors(spark, d, "ref_sentence", "hyp_sentence").groupBy("utt_id", "condition").agg(F.min_by(F.struct(normalize(F.col("ref_sentence")).alias("r"), normalize(F.col("hyp_sentence")).alias("h")), "error_id").alias("s"))
    rates = sentences.select("utt_id", "condition", cer(F.col("s.r"), F.col("s.h")).alias("cer"), F.lit(True).alias("logged"))
    x = results(spark, d).join(utterances(spark, d).select("utt_id", "duration_s"), "utt_id").join(rates, ["utt_id", "condition"], "left")
    proc = F.col("duration_s") * (hash_int(F.col("utt_id"), F.col("condition")) % 1000) / 1000
    return x.withColumn("cer", F.when(F.col("logged"), F.col("cer")).when(F.col("n_ref") > 0, 0.0)).withColumn("proc_s", proc)


@query(
    f"WITH {_SENT} SELECT condition, count(*) AS n, round(avg(wer), 6) AS mean_wer, round(avg(cer), 6) AS mean_cer, round(avg(CASE WHEN duration_s <> 0 THEN proc_s / duration_s ELSE 0 END), 6) AS mean_rtf, round(avg(proc_s), 6) AS mean_proc_s, "
    "round(avg(CASE WHEN chunk_ms IS NOT NULL THEN proc_s / greatest(1, ceil(duration_s * 1000 / chunk_ms)) END), 6) AS mean_chunk_s, max(chunk_ms) AS latency_ms FROM rs GROUP BY condition"
)
def streaming_summary(spark: SparkSession, d: str) -> DataFrame:
    """Both error rates, real-time factor, processing times and latency of every decoding condition."""
    by = summarised(decoding_results(spark, d))
    return by.select("condition", "n", *[F.round(c, 6).alias(c) for c in ("mean_wer", "mean_cer", "mean_rtf", "mean_proc_s", "mean_chunk_s")], "latency_ms")


@query(f"WITH {_UTT_COND} SELECT condition, count(*) AS n, CAST(sum(s + dl + i) AS BIGINT) AS n_errors FROM r GROUP BY condition")
def resumed_results(spark: SparkSession, d: str) -> DataFrame:
    """A run that stopped after the offline condition and was resumed: what is there already is not written again."""
    path = scratch(spark, "results")
    rows = results(spark, d).select("utt_id", "condition", (F.col("s") + F.col("dl") + F.col("i")).alias("n"))
    append_new(rows.filter("condition = 'offline'"), path, ["utt_id", "condition"])
    append_new(rows, path, ["utt_id", "condition"])
    return spark.read.parquet(path).groupBy("condition").agg(F.count("*").alias("n"), F.sum("n").alias("n_errors")).select("condition", "n", "n_errors")


@query(f"WITH {_UTT_COND}, m AS (SELECT condition, avg(wer) AS w FROM r GROUP BY condition) SELECT condition, round(w / (SELECT w FROM m WHERE condition = 'offline'), 6) AS times_offline FROM m")
def degradation_vs_offline(spark: SparkSession, d: str) -> DataFrame:
    by = results(spark, d).groupBy("condition").agg(F.avg("wer").alias("w"))
    offline = F.max(F.when(F.col("condition") == "offline", F.col("w")))
    rows = by.agg(F.collect_list(F.struct("condition", "w")).alias("all"), offline.alias("o"))  # one row a condition
    return rows.select(F.explode("all").alias("r"), "o").select("r.condition", F.round(F.try_divide(F.col("r.w"), F.col("o")), 6).alias("times_offline"))


@query(
    f"WITH {_UTT_COND} SELECT condition, CAST(sum(s) AS BIGINT) AS n_sub, CAST(sum(dl) AS BIGINT) AS n_del, CAST(sum(i) AS BIGINT) AS n_ins, "
    "round(sum(s) / nullif(sum(s + dl + i), 0), 6) AS sub_share, round(sum(dl) / nullif(sum(s + dl + i), 0), 6) AS del_share, round(sum(i) / nullif(sum(s + dl + i), 0), 6) AS ins_share FROM r GROUP BY condition"
)
def error_mix_by_condition(spark: SparkSession, d: str) -> DataFrame:
    by = results(spark, d).groupBy("condition").agg(F.sum("s").alias("n_sub"), F.sum("dl").alias("n_del"), F.sum("i").alias("n_ins"))
    whole = F.col("n_sub") + F.col("n_del") + F.col("n_ins")
    return by.select("*", *[F.round(F.try_divide(F.col(f"n_{x}").cast("double"), whole), 6).alias(f"{x}_share") for x in ("sub", "del", "ins")])


@query(f"WITH {U}, {E} SELECT u.utt_id, c.name AS condition FROM u CROSS JOIN decode_conditions c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.utt_id = u.utt_id AND e.condition = c.name)")
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """What is left to do: utterances and conditions without a logged result."""
    c = table(spark, d, "decode_conditions").select(F.col("name").alias("condition"))
    todo = utterances(spark, d).select("utt_id").crossJoin(F.broadcast(c))
    return todo.join(errors(spark, d).select("utt_id", "condition").distinct(), ["utt_id", "condition"], "left_anti")


@query(f"WITH {U} SELECT utt_id, c.name AS condition, mode FROM u CROSS JOIN decode_conditions c")
def conditions_cross(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "decode_conditions").select(F.col("name").alias("condition"), "mode")
    return utterances(spark, d).select("utt_id").crossJoin(F.broadcast(c))


@query(f"WITH {U}, {H} SELECT h.hyp_id, u.dataset, u.duration_s FROM h JOIN u USING (utt_id) WHERE h.hyp_pos = 0")
def manifest_join(spark: SparkSession, d: str) -> DataFrame:
    return hypotheses(spark, d).filter("hyp_pos = 0").join(utterances(spark, d), "utt_id").select("hyp_id", "dataset", "duration_s")


@query(f"WITH {U}, {E} SELECT error_id, coalesce(wav_path, '') AS wav_path FROM e LEFT JOIN (SELECT utt_id, wav_path FROM u) USING (utt_id)")
def wav_lookup(spark: SparkSession, d: str) -> DataFrame:
    w = utterances(spark, d).select("utt_id", "wav_path")
    return errors(spark, d).select("error_id", "utt_id").join(w, "utt_id", "left").select("error_id", F.coalesce("wav_path", F.lit("")).alias("wav_path"))


@query(
    "WITH r AS (SELECT * FROM utterances) SELECT dataset, count(*) AS n_rows, count(DISTINCT utt_id) AS n_utts, count(DISTINCT speaker) AS n_speakers, count(*) FILTER (trim(coalesce(text, '')) = '') AS n_empty, round(sum(duration_s) / 3600, 3) AS hours, count(*) FILTER (utt_id IS NULL OR text IS NULL) AS n_skipped, count(DISTINCT accent) AS n_accents FROM r GROUP BY dataset"
)
def integrity_report(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "utterances").groupBy("dataset").agg(
        F.count("*").alias("n_rows"), F.count_distinct("utt_id").alias("n_utts"), F.count_distinct("speaker").alias("n_speakers"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("n_empty"), F.round(F.sum("duration_s") / 3600, 3).alias("hours"),
        F.count_if(F.col("utt_id").isNull() | F.col("text").isNull()).alias("n_skipped"), F.count_distinct("accent").alias("n_accents"),
    )

