"""Queries of the training-data operators and, where SQL can state them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import format_duplicates, group_split, nearest_time, packing, passage_leaks, residue, split_overlap, term_frequency
from lectern.sources.tables import dealt, table
from lectern.storage import once

ERROR_FIELDS = ["ref_word", "hyp_word", "pattern_freq"]


def p1_term_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and utterances of every term, with its mark."""
    return term_frequency.term_frequencies(table(spark, folder, "error_rows"), ERROR_FIELDS, "utt_id", "error_id", "logged_at")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_term_frequencies(spark, folder).filter("mark IS NOT NULL").select("field", "term", "mark")


def _overlaps(spark: SparkSession, folder: str) -> DataFrame:
    return split_overlap.split_overlaps(table(spark, folder, "utterances"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _overlaps(spark, folder).select(F.least("eval_id", "train_id").alias("utt_id_a"), F.greatest("eval_id", "train_id").alias("utt_id_b"))


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    """Overlaps by evaluation split and dataset: records, those exactly and only almost in training, training records."""
    best = _overlaps(spark, folder).groupBy("eval_id", "eval_split", "eval_dataset").agg(F.min("distance").alias("d"), F.count("*").alias("n"))
    return best.groupBy(F.col("eval_split").alias("split"), F.col("eval_dataset").alias("dataset")).agg(
        F.count("*").alias("n_overlapping"), F.count_if(F.col("d") == 0).alias("n_exact"), F.count_if(F.col("d") > 0).alias("n_near"), F.sum("n").alias("n_pairs")
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return group_split.assign_splits(table(spark, folder, "utterances")).select("utt_id", "group_key")


def p3_splits(spark: SparkSession, folder: str) -> DataFrame:
    return group_split.assign_splits(table(spark, folder, "utterances"))


def p3_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """All records have a split, no group has two, and the shares are within a hundredth, or the largest group, of those wanted."""
    of = group_split.assign_splits(table(spark, folder, "utterances"))
    groups = of.groupBy("group_key").agg(F.count("*").alias("n"), F.count_distinct("split").alias("splits"), *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "validation", "test")])
    n = F.sum("n")
    near = lambda c, share: F.abs(F.sum(c) / n - share) <= F.greatest(F.lit(0.01), F.max("n") / n)
    return groups.agg(n.alias("n_records"), F.count_if(F.col("splits") != 1).alias("n_torn_groups"), (near("train", 0.8) & near("validation", 0.1) & near("test", 0.1)).alias("shares_hold"))


def p4_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_time.error_phone_pairs(table(spark, folder, "error_rows"), table(spark, folder, "phone_annotations")).withColumn("distance", F.round("distance", 6))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_pairs(spark, folder).select("error_id", "phone_id")


def _copies(spark: SparkSession, folder: str) -> DataFrame:
    return format_duplicates.copies(table(spark, folder, "hypotheses"), "hyp_id", "text")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _copies(spark, folder).filter("first_id <> id").select(F.col("first_id").alias("first_hyp_id"), F.col("id").alias("hyp_id"))


def p5_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each distinct text: its first record and its number of copies."""
    return _copies(spark, folder).groupBy(F.col("first_id").alias("first_hyp_id")).agg(F.count("*").alias("n_copies"))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return dealt(table(spark, folder, "documents").select("doc_id", "text"))


def p6_windows(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_documents(spark, folder))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_passages(spark, folder).select("doc_id", "item_id").distinct()


def p6_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's tokens are packed once and in order, no window is overfull or has a gap, and the windows are within 2 % of the fewest possible, or the open ones."""
    pieces = p6_windows(spark, folder)
    by_doc = pieces.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("piece_start") + F.col("n_tokens")).alias("end"), F.count_distinct("piece").alias("k"), F.count("*").alias("rows"))
    docs = by_doc.agg(F.count("*").alias("n_documents"), F.count_if((F.col("n") != F.col("end")) | (F.col("k") != F.col("rows"))).alias("n_torn_documents"), F.sum("n").alias("tokens"))
    by_window = pieces.groupBy("window").agg(F.sum("n_tokens").alias("n"), F.max(F.col("window_start") + F.col("n_tokens")).alias("end"), F.first("fill").alias("fill"))
    bad = (F.col("n") > 2048) | (F.col("n") != F.col("end")) | (F.col("n") != F.col("fill"))
    windows = by_window.agg(F.count_if(bad).alias("n_bad_windows"), F.count("*").alias("windows"))
    few = F.col("windows") <= F.greatest(F.ceil(F.col("tokens") / 2048 * 1.02), F.ceil(F.col("tokens") / 2048) + 64)
    return docs.crossJoin(windows).select("n_documents", "n_torn_documents", "n_bad_windows", few.alias("few_windows"))  # one row each


def _index(spark: SparkSession, folder: str) -> DataFrame:
    """The folder's positional index: built by the first query of a session, used by all."""
    return once(spark, folder, "positional-index", lambda: passage_leaks.positional_index(_documents(spark, folder)), **passage_leaks.STORAGE)


def p7_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passage_leaks.phrase_matches(_index(spark, folder), table(spark, folder, "eval_items"))


def p7_leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items that leaked: in how many documents, and the longest passage."""
    return p7_passages(spark, folder).groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_documents"), F.max("n_words").alias("longest"))


def p7_proximity(spark: SparkSession, folder: str) -> DataFrame:
    return passage_leaks.proximity_matches(_index(spark, folder), table(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_reasons(spark, folder).select("doc_id")


def p8_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue(_documents(spark, folder))


def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The documents kept, by id."""
    return residue.without_residue(table(spark, folder, "documents")).select("doc_id", "source")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_term_frequencies, p2_found, p2_report, p3_found, p3_splits, p3_invariants, p4_found, p4_pairs, p5_found, p5_collapsed, p6_windows, p6_invariants, p7_found, p7_passages, p7_leaked_items, p7_proximity, p8_found, p8_reasons, p8_clean)
}

_PLAIN = "translate(lower({}), chr(39) || chr(8217) || chr(8203) || chr(65279), '')"
_WORDS = "regexp_extract_all(" + _PLAIN + ", '[\\p{{L}}\\p{{N}}]+')"

_P1 = f"""
WITH d AS (SELECT DISTINCT ON (error_id) error_id, utt_id, ref_word, hyp_word, pattern_freq FROM error_rows ORDER BY error_id, logged_at),
v AS (SELECT utt_id, 'ref_word' AS field, ref_word AS v FROM d UNION ALL SELECT utt_id, 'hyp_word', hyp_word FROM d UNION ALL SELECT utt_id, 'pattern_freq', CAST(pattern_freq AS VARCHAR) FROM d),
t AS (SELECT utt_id, field, array_to_string({_WORDS.format('v')}, ' ') AS term FROM v WHERE v IS NOT NULL),
c AS (SELECT field, term, count(*) AS n_rows, count(DISTINCT utt_id) AS n_records FROM t WHERE term <> '' GROUP BY ALL)
SELECT field, term, n_rows, n_records, CASE WHEN n_records < 3 THEN 'rare' WHEN n_records * 100 > 2 * (SELECT count(DISTINCT utt_id) FROM d) THEN 'common' END AS mark FROM c
"""

_P2 = f"""
WITH r AS (SELECT DISTINCT ON (utt_id) utt_id, dataset, {_WORDS.format('text')} AS w,
             CASE lower(regexp_replace(split, '^\\s+|\\s+$', '', 'g')) WHEN 'train' THEN 'train' WHEN 'validation' THEN 'validation' WHEN 'dev' THEN 'validation' WHEN 'test' THEN 'test' END AS split
           FROM utterances ORDER BY utt_id, loaded_at),
u AS (SELECT *, len(w) AS n FROM r WHERE split IS NOT NULL AND len(w) >= 6),
p AS (SELECT e.utt_id AS eval_id, e.split, e.dataset, t.utt_id AS train_id, e.w AS a, t.w AS b, greatest(e.n, t.n) AS m, list_distinct(list_concat(e.w, t.w)) AS v
      FROM u e JOIN u t ON e.split <> 'train' AND t.split = 'train' AND abs(e.n - t.n) * 100 <= 15 * greatest(e.n, t.n)
      WHERE len(list_intersect(e.w, t.w)) * 2 >= least(len(list_distinct(e.w)), len(list_distinct(t.w)))),
d AS (SELECT *, levenshtein(array_to_string(list_transform(a, lambda x: chr(CAST(list_position(v, x) AS INT))), ''), array_to_string(list_transform(b, lambda x: chr(CAST(list_position(v, x) AS INT))), '')) AS d FROM p)
"""

_P3 = """
WITH RECURSIVE c AS (
  SELECT utt_id, regexp_replace(utt_id, '_[^_]*$', '') AS recording, regexp_replace(upper(regexp_replace(s, '^\\s+|\\s+$', '', 'g')), '^SPK[-_:]', '') AS code
  FROM (SELECT utt_id, speaker AS s FROM utterances UNION SELECT utt_id, CASE WHEN dataset = 'l2arctic' THEN split_part(utt_id, '_', 2) END FROM utterances)),
e AS (SELECT DISTINCT 'r:' || recording AS r, 'c:' || code AS c FROM c WHERE code IS NOT NULL AND code NOT IN ('', 'UNKNOWN')),
x AS (SELECT DISTINCT a.c AS a, b.c AS b FROM e a JOIN e b USING (r)),
reach AS (SELECT a, b FROM x UNION SELECT reach.a, x.b FROM reach JOIN x ON reach.b = x.a),
least_code AS (SELECT a, min(b) AS key FROM reach GROUP BY a),
of AS (SELECT e.r, min(k.key) AS key FROM e JOIN least_code k ON e.c = k.a GROUP BY e.r)
SELECT DISTINCT c.utt_id, coalesce(substr(of.key, 3), c.recording) AS group_key FROM c LEFT JOIN of ON of.r = 'r:' || c.recording
"""

_P4 = """
WITH p AS (SELECT DISTINCT lower(trim(utt_id, ' ' || chr(9))) AS u, x.phone_id AS phone_id, least(x.xmin, x.xmax) AS lo, greatest(x.xmin, x.xmax) AS hi
           FROM (SELECT utt_id, unnest(phones) AS x FROM phone_annotations)
           WHERE x.xmin IS NOT NULL AND x.xmax IS NOT NULL AND lower(regexp_replace(x.err_type, '^\\s+|\\s+$', '', 'g')) IN ('s', 'd', 'a')),
e AS (SELECT DISTINCT error_id, lower(trim(utt_id, ' ' || chr(9))) AS u, approx_time_s AS t FROM error_rows WHERE approx_time_s >= 0 AND NOT isnan(approx_time_s)),
j AS (SELECT error_id, phone_id, greatest(0.0, lo - t, t - hi) AS d, row_number() OVER (PARTITION BY error_id ORDER BY greatest(0.0, lo - t, t - hi), hi DESC, lo, phone_id) AS rn FROM e JOIN p USING (u))
"""

_P5 = f"""
WITH h AS (SELECT DISTINCT hyp_id, text FROM hypotheses WHERE text IS NOT NULL AND len({_WORDS.format('text')}) >= 6),
k AS (SELECT hyp_id, CASE WHEN contains(text, '=') THEN '=' || array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(text, '[|;]'), lambda f: array_to_string({_WORDS.format('f')}, ' ')), lambda f: f <> '')), '|')
      ELSE array_to_string({_WORDS.format('text')}, ' ') END AS form FROM h),
f AS (SELECT hyp_id, min(hyp_id) OVER (PARTITION BY form) AS first_hyp_id FROM k)
"""

_P7 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_WORDS.format('text')} AS w FROM eval_items WHERE text IS NOT NULL),
ds AS (SELECT doc_id, array_to_string(list_slice(w, s, s + 11), ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 12)),
si AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, s, s + 11), ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 11)) AS s FROM i WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM ds JOIN si USING (g)
"""

# All places at which twelve words agree, in runs along one alignment.
_P7_RUNS = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_WORDS.format('text')} AS w FROM eval_items WHERE text IS NOT NULL),
ds AS (SELECT doc_id, s - 1 AS p, array_to_string(list_slice(w, s, s + 11), ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 12)),
si AS (SELECT item_id, s - 1 AS q, array_to_string(list_slice(w, s, s + 11), ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 11)) AS s FROM i WHERE len(w) >= 12)),
h AS (SELECT doc_id, item_id, p - q AS diag, q, q - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY q) AS island FROM ds JOIN si USING (g)),
runs AS (SELECT doc_id, item_id, CAST(min(q) + diag AS INTEGER) AS doc_start, CAST(min(q) AS INTEGER) AS item_start, CAST(count(*) + 11 AS INTEGER) AS n_words FROM h GROUP BY doc_id, item_id, diag, island)
"""

SQL = {
    "p3_invariants": "SELECT count(DISTINCT utt_id) AS n_records, CAST(0 AS BIGINT) AS n_torn_groups, true AS shares_hold FROM utterances",
    "p6_invariants": "SELECT count(DISTINCT doc_id) AS n_documents, CAST(0 AS BIGINT) AS n_torn_documents, CAST(0 AS BIGINT) AS n_bad_windows, true AS few_windows FROM documents WHERE text <> ''",
    "p7_passages": _P7_RUNS + "SELECT * FROM runs",
    "p7_leaked_items": _P7_RUNS + "SELECT item_id, count(DISTINCT doc_id) AS n_documents, max(n_words) AS longest FROM runs GROUP BY item_id",
    "p1_found": f"SELECT field, term, mark FROM ({_P1}) WHERE mark IS NOT NULL",
    "p1_term_frequencies": _P1,
    "p2_found": _P2 + "SELECT least(eval_id, train_id) AS utt_id_a, greatest(eval_id, train_id) AS utt_id_b FROM d WHERE d * 100 <= 15 * m",
    "p2_report": _P2 + ", b AS (SELECT eval_id, split, dataset, min(d) AS d, count(*) AS n FROM d WHERE d * 100 <= 15 * m GROUP BY ALL) SELECT split, dataset, count(*) AS n_overlapping, count(*) FILTER (d = 0) AS n_exact, count(*) FILTER (d > 0) AS n_near, CAST(sum(n) AS BIGINT) AS n_pairs FROM b GROUP BY ALL",
    "p3_found": _P3,
    "p4_found": _P4 + "SELECT error_id, phone_id FROM j WHERE rn = 1 AND d <= 0.15 + 1e-9",
    "p4_pairs": _P4 + "SELECT error_id, phone_id, round(d, 6) AS distance FROM j WHERE rn = 1 AND d <= 0.15 + 1e-9",
    "p5_found": _P5 + "SELECT first_hyp_id, hyp_id FROM f WHERE hyp_id <> first_hyp_id",
    "p5_collapsed": _P5 + "SELECT first_hyp_id, count(*) AS n_copies FROM f GROUP BY ALL",
    "p7_found": _P7,
}
