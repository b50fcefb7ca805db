"""Registry of queries, relations they share, and the same relations in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.distance import with_word_edits
from lectern.functions.text import tokens
from lectern.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def utterances(spark: SparkSession, d: str) -> DataFrame:
    """The manifest, one row for each utterance: its first delivery."""
    cols = ["dataset", "wav_path", "text", "duration_s", "speaker", "accent", "cefr", "extra", "split"]
    rows = table(spark, d, "utterances").filter("utt_id IS NOT NULL")
    return rows.groupBy("utt_id").agg(F.min_by(F.struct(*cols), "loaded_at").alias("u")).select("utt_id", "u.*")


def hypotheses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hypotheses").dropDuplicates(["hyp_id"])


def errors(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """The error log, one row for each error: its first delivery; with ``more`` columns, if any."""
    cols = ["utt_id", "dataset", "condition", "op", "ref_word", "hyp_word", "ref_context", "approx_time_s", "why_category", "annotator_notes", "accent", *more]
    return table(spark, d, "error_rows").groupBy("error_id").agg(F.min_by(F.struct(*cols), "logged_at").alias("e")).select("error_id", "e.*")


def scored_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    """(utt_id, dataset, accent, cefr, ref, hyp, pos, hyp_id, text, acoustic, n_ref, n_hyp, edits, wer) of all n-best entries with a text."""
    u = utterances(spark, d).select("utt_id", "dataset", "accent", "cefr", "speaker", tokens(F.col("text")).alias("ref"))
    h = hypotheses(spark, d).filter("text IS NOT NULL AND acoustic_score IS NOT NULL").select("utt_id", "hyp_id", F.col("hyp_pos").alias("pos"), "text", F.col("acoustic_score").alias("acoustic"), tokens(F.col("text")).alias("hyp"))
    return with_word_edits(u.filter("ref IS NOT NULL").join(h, "utt_id"), "ref", "hyp")


def top_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The list entries at place 0."""
    return scored_hypotheses(spark, d).filter("pos = 0")


# ---- the same in SQL ---------------------------------------------------------------------------


def norm(x: str) -> str:
    """normalize() without look-around: chr(1) stands for an apostrophe between letters."""
    kept = "regexp_replace(regexp_replace({}, '([a-z])''([a-z])', '\\1' || chr(1) || '\\2', 'g'), '([a-z])''([a-z])', '\\1' || chr(1) || '\\2', 'g')"
    bare = f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\s'']', ' ', 'g')"
    return f"trim(regexp_replace(replace(replace({kept.format(bare)}, chr(39), ' '), chr(1), chr(39)), '\\s+', ' ', 'g'))"


def toks(x: str) -> str:
    return f"list_filter(string_split({norm(x)}, ' '), lambda t: t <> '')"


def edits(a: str, b: str) -> str:
    """Word edit distance: words become single bytes, so a pair may hold 127 distinct words."""
    code = "array_to_string(list_transform({}, lambda t: chr(CAST(list_position(list_distinct(list_concat(" + f"{a}, {b}" + ")), t) AS INTEGER))), '')"
    return f"levenshtein({code.format(a)}, {code.format(b)})"


U = "u AS (SELECT DISTINCT ON (utt_id) * FROM utterances WHERE utt_id IS NOT NULL ORDER BY utt_id, loaded_at)"
E = "e AS (SELECT DISTINCT ON (error_id) * FROM error_rows ORDER BY error_id, logged_at)"
H = "h AS (SELECT DISTINCT * FROM hypotheses)"
PAIRS = f"""{U}, {H}, p0 AS (SELECT u.utt_id, u.dataset, u.accent, u.cefr, u.speaker, {toks('u.text')} AS ref, {toks('h.text')} AS hyp, h.hyp_pos AS pos, h.hyp_id, h.text, h.acoustic_score AS acoustic
  FROM u JOIN h USING (utt_id) WHERE u.text IS NOT NULL AND h.text IS NOT NULL AND h.acoustic_score IS NOT NULL),
p AS (SELECT *, len(ref) AS n_ref, len(hyp) AS n_hyp, {edits('ref', 'hyp')} AS edits FROM p0)"""
KEY = "lower(trim({}, ' ' || chr(9)))"
SPANS = f"s AS (SELECT {KEY.format('utt_id')} AS key, list_distinct(flatten(list(phones) FILTER (phones IS NOT NULL))) AS phones FROM phone_annotations WHERE utt_id IS NOT NULL GROUP BY ALL)"


def md5_int(x: str) -> str:
    return f"CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT)"
