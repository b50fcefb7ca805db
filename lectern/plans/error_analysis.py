"""Queries over the error log and phone annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.phonetics import jaro_winkler_similarity, phonetic_similar
from lectern.functions.text import context_frame, normalize, tokens
from lectern.operators import errors as ops
from lectern.operators.spans import nearest_span, span_label, utterance_key
from lectern.plans.base import E, KEY, SPANS, U, errors, norm, query, toks, utterances
from lectern.sources.tables import table

TOLERANCE = 0.15


@query(f"WITH {E}, c AS (SELECT op, ref_word, hyp_word, count(*) AS n FROM e GROUP BY ALL) SELECT * FROM c ORDER BY n DESC, op, ref_word NULLS LAST, hyp_word NULLS LAST LIMIT 20")
def pattern_freq_topk(spark: SparkSession, d: str) -> DataFrame:
    """The twenty most frequent error patterns."""
    c = ops.pattern_frequency(errors(spark, d))
    return c.orderBy(F.desc("n"), "op", F.asc_nulls_last("ref_word"), F.asc_nulls_last("hyp_word")).limit(20)


@query(f"WITH {E} SELECT error_id, count(*) OVER (PARTITION BY op, ref_word, hyp_word) AS n FROM e")
def pattern_freq_by_row(spark: SparkSession, d: str) -> DataFrame:
    return ops.with_pattern_frequency(errors(spark, d).select("error_id", "op", "ref_word", "hyp_word")).select("error_id", "n")


@query(f"WITH {E} SELECT op, count(*) AS n FROM e GROUP BY op")
def op_counts(spark: SparkSession, d: str) -> DataFrame:
    return errors(spark, d).groupBy("op").agg(F.count("*").alias("n"))


@query(
    f"WITH {E}, c AS (SELECT count(*) AS k FROM e GROUP BY op, ref_word, hyp_word), n AS (SELECT k AS n, count(*) AS n_patterns, CAST(sum(k) AS BIGINT) AS n_errors FROM c GROUP BY k) "
    "SELECT n, n_patterns, n_errors, round(sum(n_errors) OVER (ORDER BY n DESC) / sum(n_errors) OVER (), 6) AS covered FROM n"
)
def coverage_curve(spark: SparkSession, d: str) -> DataFrame:
    return ops.coverage(ops.pattern_frequency(errors(spark, d))).withColumn("covered", F.round("covered", 6))


_TIME = "CASE WHEN approx_time_s >= 0 AND NOT isnan(approx_time_s) THEN approx_time_s END"


@query(f"WITH {E} SELECT error_id, coalesce(last_value({_TIME} IGNORE NULLS) OVER (PARTITION BY utt_id, condition ORDER BY error_id ROWS UNBOUNDED PRECEDING), 0.0) AS time_s FROM e")
def locf_time(spark: SparkSession, d: str) -> DataFrame:
    known = F.when((F.col("approx_time_s") >= 0) & ~F.isnan("approx_time_s"), F.col("approx_time_s"))
    return ops.with_error_time(errors(spark, d).withColumn("t", known), ["utt_id", "condition"], ["error_id"], "t").select("error_id", "time_s")


@query(
    f"WITH {U}, w AS (SELECT utt_id, {toks('text')} AS t FROM u WHERE text IS NOT NULL), x AS (SELECT utt_id, t, unnest(generate_series(1, len(t))) AS i FROM w) "
    "SELECT utt_id, i - 1 AS at, array_to_string(list_concat(list_concat(list_slice(t, greatest(i - 3, 1), i - 1), ['[' || t[i] || ']']), list_slice(t, i + 1, i + 3)), ' ') AS frame FROM x"
)
def context_frames(spark: SparkSession, d: str) -> DataFrame:
    """The frame of three tokens on either side of every token of the manifest."""
    w = utterances(spark, d).filter("text IS NOT NULL").select("utt_id", tokens(F.col("text")).alias("t"))
    x = w.select("utt_id", "t", F.posexplode("t").alias("at", "_"))
    return x.select("utt_id", F.col("at").cast("long").alias("at"), context_frame(F.col("t"), F.col("at")).alias("frame"))


def _in(x: str, words: list[str]) -> str:
    return f"{x} IN ({', '.join(repr(w) for w in words)})"


def _pairs(a: str, b: str, pairs: list[tuple[str, str]]) -> str:
    return "(" + " OR ".join(f"({a} = '{x}' AND {b} = '{y}') OR ({a} = '{y}' AND {b} = '{x}')" for x, y in pairs) + ")"


_A, _B = "lower(coalesce(ref_word, ''))", "lower(coalesce(hyp_word, ''))"
_NUMBER = f"((regexp_matches({_A}, '\\p{{Nd}}') OR {_in(_A, ops.NUMBER_WORDS)}) AND (regexp_matches({_B}, '\\p{{Nd}}') OR {_in(_B, ops.NUMBER_WORDS)}) AND {_A} <> {_B})"
_STEM = f"(substr({_A}, 1, greatest(length({_A}) - 2, 0)) = substr({_B}, 1, greatest(length({_B}) - 2, 0)) AND ((length({_A}) > 3 AND right({_A}, 2) IN ('re', 'ur')) OR (length({_B}) > 3 AND right({_B}, 2) IN ('re', 'ur'))))"
_SPELLING = f"({_pairs(_A, _B, ops.SPELLINGS)} OR {_STEM})"
_COLLOQUIAL = _pairs(f"trim({_A}, chr(39))", f"trim({_B}, chr(39))", ops.COLLOQUIAL)


@query(f"WITH {E} SELECT error_id, {_NUMBER} AS number_form, {_SPELLING} AS spelling, {_COLLOQUIAL} AS colloquial FROM e WHERE op = 'substitute'")
def lexicon_pair_flags(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("ref_word"), F.col("hyp_word")
    return errors(spark, d).filter("op = 'substitute'").select("error_id", ops.is_number_form(a, b).alias("number_form"), ops.is_spelling(a, b).alias("spelling"), ops.is_colloquial(a, b).alias("colloquial"))


def spans(spark: SparkSession, d: str) -> DataFrame:
    """(key, spans): mispronounced phones that have both ends, in order of their ids; repeated rows are merged."""
    p = table(spark, d, "phone_annotations").filter("utt_id IS NOT NULL").groupBy(utterance_key(F.col("utt_id")).alias("key"))
    phones = p.agg(F.array_distinct(F.flatten(F.collect_list("phones"))).alias("phones"))
    marked = F.filter("phones", lambda x: (F.trim(F.coalesce(x["err_type"], F.lit(""))) != "") & x["xmin"].isNotNull() & x["xmax"].isNotNull())
    return phones.select("key", F.coalesce(F.array_sort(marked, lambda a, b: F.when(a["phone_id"] < b["phone_id"], -1).otherwise(1)), F.array()).alias("spans"))


def coinciding(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Errors of annotated utterances with their nearest mispronounced phone; utterances without one stay."""
    e = errors(spark, d, *more).filter((F.col("approx_time_s") >= 0) & ~F.isnan("approx_time_s"))
    x = e.withColumn("key", utterance_key(F.col("utt_id"))).join(spans(spark, d), "key").withColumn("m", nearest_span(F.col("approx_time_s"), F.col("spans"), TOLERANCE))
    span = F.get("spans", F.col("m.i"))
    return x.select(*[c for c in e.columns], F.coalesce(F.col("m.d") == 0, F.lit(False)).alias("coincides"), F.coalesce(span_label(span), F.lit("")).alias("label"), F.bround("m.d", 3).alias("distance"))


_COINCIDING = f"""{E}, {SPANS}, sp AS (SELECT key, list_sort(list_transform(list_filter(coalesce(phones, []), lambda x: trim(coalesce(x.err_type, '')) <> '' AND x.xmin IS NOT NULL AND x.xmax IS NOT NULL),
    lambda x: {{'phone_id': x.phone_id, 'xmin': x.xmin, 'xmax': x.xmax, 'label': coalesce(x.canonical, '') || '>' || coalesce(x.perceived, '') || '(' || coalesce(x.err_type, '') || ')'}})) AS spans FROM s),
x AS (SELECT e.*, spans FROM e JOIN sp ON {KEY.format('e.utt_id')} = key WHERE approx_time_s >= 0 AND NOT isnan(approx_time_s)),
y AS (SELECT *, list_sort(list_transform(spans, lambda q, i: {{'d': CASE WHEN approx_time_s >= q.xmin - {TOLERANCE} AND approx_time_s <= q.xmax + {TOLERANCE} THEN 0.0::DOUBLE ELSE least(abs(approx_time_s - q.xmin), abs(approx_time_s - q.xmax)) END, 'i': i, 'label': q.label}}))[1] AS m FROM x),
co AS (SELECT *, coalesce(m.d = 0, false) AS coincides, coalesce(m.label, '') AS label, round_even(m.d, 3) AS distance FROM y)"""


@query(f"WITH {_COINCIDING} SELECT error_id, coincides, label, distance FROM co")
def nearest_span_join(spark: SparkSession, d: str) -> DataFrame:
    return coinciding(spark, d).select("error_id", "coincides", "label", "distance")


@query(f"WITH {_COINCIDING} SELECT op, count(*) AS n, count(*) FILTER (coincides) AS n_coincide, round_even(count(*) FILTER (coincides) / count(*), 4) AS share FROM co GROUP BY op")
def coincidence_rate(spark: SparkSession, d: str) -> DataFrame:
    hit = F.count_if("coincides")
    return coinciding(spark, d).groupBy("op").agg(F.count("*").alias("n"), hit.alias("n_coincide"), F.bround(F.try_divide(hit.cast("double"), F.count("*")), 4).alias("share"))


_CLASSES = f"""{_COINCIDING}, {U}, f AS (SELECT co.*, contains(hn, rn) AND len(string_split(hn, ' ')) > len(list_filter(string_split(rn, ' '), lambda t: t <> '')) AS truncated
  FROM (SELECT co.*, {norm('hyp_sentence')} AS hn, {norm('ref_sentence')} AS rn FROM co) co),
k AS (SELECT *, CASE WHEN op = 'insert' AND coalesce(truncated, false) THEN 'reference_error' WHEN op = 'substitute' AND {_COLLOQUIAL} THEN 'reference_error' WHEN op = 'substitute' AND ({_NUMBER} OR {_SPELLING}) THEN 'normalization'
  WHEN coincides THEN 'accent_phoneme' WHEN op = 'insert' AND {_B} <> '' AND list_contains(regexp_extract_all(lower(coalesce(ref_context, '')), '[a-z0-9'']+'), {_B}) THEN 'disfluency'
  WHEN op = 'insert' THEN 'hallucination' WHEN op = 'substitute' THEN 'model_lexical' WHEN op = 'delete' THEN 'deletion_other' ELSE 'other' END AS category FROM f)"""


def categorized(spark: SparkSession, d: str) -> DataFrame:
    x = coinciding(spark, d, "ref_sentence", "hyp_sentence")
    truncated = ops.reference_truncated(normalize(F.col("ref_sentence")), normalize(F.col("hyp_sentence")))
    return x.withColumn("category", ops.classify(F.col("op"), F.col("ref_word"), F.col("hyp_word"), F.col("ref_context"), F.col("coincides"), truncated)).drop("ref_sentence", "hyp_sentence")


@query(f"WITH {_CLASSES} SELECT category, count(*) AS n, round_even(count(*) / sum(count(*)) OVER (), 4) AS share FROM k GROUP BY category ORDER BY n DESC")
def error_categories(spark: SparkSession, d: str) -> DataFrame:
    by = categorized(spark, d).groupBy("category").agg(F.count("*").alias("n"))  # a handful of rows
    return by.select("category", "n", F.bround(F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("share")).orderBy(F.desc("n"))


@query(
    f"WITH {_CLASSES}, c AS (SELECT category, count(*) FILTER (condition = 'offline') AS n_base, count(*) FILTER (condition = 'stream_1280ms') AS n_other FROM k WHERE condition IN ('offline', 'stream_1280ms') GROUP BY category) "
    "SELECT category, n_base, n_other, n_other - n_base AS delta, greatest(n_base - n_other, 0) AS fixed, greatest(n_other - n_base, 0) AS regressed FROM c"
)
def category_delta(spark: SparkSession, d: str) -> DataFrame:
    """Error categories of two systems side by side, over the union of their categories."""
    n = lambda c: F.count_if(F.col("condition") == c)
    by = categorized(spark, d).filter(F.col("condition").isin("offline", "stream_1280ms")).groupBy("category").agg(n("offline").alias("n_base"), n("stream_1280ms").alias("n_other"))
    delta = F.col("n_other") - F.col("n_base")
    return by.select("*", delta.alias("delta"), F.greatest(-delta, F.lit(0)).alias("fixed"), F.greatest(delta, F.lit(0)).alias("regressed"))


_LETTERS = "regexp_replace(lower({}), '[^a-z]', '', 'g')"


@query(
    f"WITH {E}, w AS (SELECT error_id, {_LETTERS.format('ref_word')} AS a, {_LETTERS.format('hyp_word')} AS b FROM e WHERE op = 'substitute') SELECT error_id, round(jaro_winkler_similarity(a, b), 6) AS likeness FROM w WHERE a <> '' AND b <> ''"
)
def jaro_winkler_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Likeness of the letters of substituted words."""
    letters = lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "")
    w = errors(spark, d).filter("op = 'substitute'").select("error_id", letters("ref_word").alias("a"), letters("hyp_word").alias("b")).filter("a <> '' AND b <> ''")
    pairs = w.select("a", "b").distinct()  # each pair of words is compared once
    scored = pairs.withColumn("likeness", F.round(jaro_winkler_similarity(F.col("a"), F.col("b")), 6))
    return w.join(scored, ["a", "b"]).select("error_id", "likeness")


_RATIO = lambda a, b: f"coalesce({a} / nullif({b}, 0), 0.0)"
_PE = "((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)"


@query(
    f"""WITH {_COINCIDING}, w AS (SELECT coincides, {_LETTERS.format('ref_word')} AS a, {_LETTERS.format('hyp_word')} AS b FROM co WHERE op = 'substitute'), l AS (SELECT coincides, jaro_winkler_similarity(a, b) >= 0.86 AS pred FROM w WHERE a <> '' AND b <> ''),
    c AS (SELECT CAST(count(*) FILTER (pred AND coincides) AS DOUBLE) AS tp, CAST(count(*) FILTER (pred AND NOT coincides) AS DOUBLE) AS fp, CAST(count(*) FILTER (NOT pred AND coincides) AS DOUBLE) AS fn, CAST(count(*) FILTER (NOT pred AND NOT coincides) AS DOUBLE) AS tn, CAST(count(*) AS DOUBLE) AS n FROM l),
    k AS (SELECT *, {_RATIO('(tp + tn)', 'n')} AS po, {_RATIO('tp', '(tp + fp)')} AS pr, {_RATIO('tp', '(tp + fn)')} AS re, {_PE} AS pe FROM c)
    SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round_even(po, 3) AS agreement, round_even(pr, 3) AS precision, round_even(re, 3) AS recall, round_even({_RATIO('2 * pr * re', '(pr + re)')}, 3) AS f1, round_even({_RATIO('(po - pe)', '(1 - pe)')}, 3) AS kappa FROM k"""
)
def likeness_confusion_kappa(spark: SparkSession, d: str) -> DataFrame:
    """The same of the letters' likeness alone, from 0.86 on."""
    letters = lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "")
    x = coinciding(spark, d).filter("op = 'substitute'").select(letters("ref_word").alias("a"), letters("hyp_word").alias("b"), "coincides").filter("a <> '' AND b <> ''")
    by = x.groupBy("a", "b", "coincides").agg(F.count("*").alias("n")).withColumn("pred", jaro_winkler_similarity(F.col("a"), F.col("b")) >= 0.86)
    return by.agg(*ops.agreement(F.col("pred"), F.col("coincides"), F.col("n")))


@query()
def phonetic_confusion_kappa(spark: SparkSession, d: str) -> DataFrame:
    """How well phonetic likeness predicts that a substitution coincides with a mispronounced phone."""
    by = coinciding(spark, d).filter("op = 'substitute'").groupBy("ref_word", "hyp_word", "coincides").agg(F.count("*").alias("n"))
    like = by.withColumn("pred", phonetic_similar(F.col("ref_word"), F.col("hyp_word")))  # once for a pair of words
    return like.agg(*ops.agreement(F.col("pred"), F.col("coincides"), F.col("n")))


_RULE = f"""CASE why_category WHEN 'accent_phoneme' THEN op IN ('substitute', 'delete') AND {_A} <> '' WHEN 'hallucination' THEN op IN ('insert', 'substitute') AND {_B} <> '' AND NOT contains(lower(coalesce(ref_context, '')), {_B})
  WHEN 'normalization' THEN regexp_matches({_A} || {_B}, '\\p{{Nd}}') OR {_in(_A, ops.AUDITED_NUMBER_WORDS)} OR {_in(_B, ops.AUDITED_NUMBER_WORDS)} WHEN 'model_lexical' THEN op IN ('substitute', 'delete', 'insert') WHEN 'deletion_other' THEN op = 'delete' ELSE true END"""


@query(f"WITH {E} SELECT why_category AS category, count(*) AS n, count(*) FILTER ({_RULE}) AS n_hold FROM e WHERE trim(why_category) <> '' GROUP BY ALL")
def rule_audit(spark: SparkSession, d: str) -> DataFrame:
    e = errors(spark, d).filter(F.trim("why_category") != "")
    holds = ops.rule_holds(F.col("why_category"), F.col("op"), F.col("ref_word"), F.col("hyp_word"), F.col("ref_context"))
    return e.groupBy(F.col("why_category").alias("category")).agg(F.count("*").alias("n"), F.count_if(holds).alias("n_hold"))


@query(
    f"""WITH {E}, x AS (SELECT why_category AS category, error_id, row_number() OVER (PARTITION BY why_category ORDER BY error_id) AS r FROM e WHERE trim(why_category) <> '' AND NOT coalesce({_RULE}, false)) SELECT category, r AS example, error_id FROM x WHERE r <= 5"""
)
def rule_audit_examples(spark: SparkSession, d: str) -> DataFrame:
    """The first five errors of each category that break its rule."""
    e = errors(spark, d).filter(F.trim("why_category") != "")
    holds = F.coalesce(ops.rule_holds(F.col("why_category"), F.col("op"), F.col("ref_word"), F.col("hyp_word"), F.col("ref_context")), F.lit(False))
    rank = F.row_number().over(Window.partitionBy("category").orderBy("error_id"))
    broken = e.filter(~holds).select(F.col("why_category").alias("category"), "error_id").withColumn("example", rank)
    return broken.filter("example <= 5").select("category", F.col("example").cast("long").alias("example"), "error_id")


@query(f"WITH {E} SELECT condition, count(*) AS n, count(*) FILTER (trim(coalesce(why_category, '')) <> '') AS n_labelled, round(count(*) FILTER (trim(coalesce(why_category, '')) <> '') / count(*), 6) AS share FROM e GROUP BY ALL")
def annotation_completion(spark: SparkSession, d: str) -> DataFrame:
    done = F.count_if(F.trim(F.coalesce("why_category", F.lit(""))) != "")
    return errors(spark, d).groupBy("condition").agg(F.count("*").alias("n"), done.alias("n_labelled"), F.round(done / F.count("*"), 6).alias("share"))


@query(
    f"""WITH {_CLASSES}, h AS (SELECT category AS auto_category, CASE WHEN trim(coalesce(why_category, '')) <> '' THEN why_category ELSE category END AS human FROM k)
    SELECT auto_category, count(*) AS n, count(*) FILTER (human = auto_category) AS n_agree, round(avg(CASE WHEN human = auto_category THEN 1.0 ELSE 0.0 END), 6) AS rate FROM h GROUP BY ALL"""
)
def label_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Labels from the rules against those in the log; a row without a label keeps the rule's."""
    human = F.when(F.trim(F.coalesce("why_category", F.lit(""))) != "", F.col("why_category")).otherwise(F.col("category"))
    x = categorized(spark, d).withColumn("same", human == F.col("category"))
    return x.groupBy(F.col("category").alias("auto_category")).agg(F.count("*").alias("n"), F.count_if("same").alias("n_agree"), F.round(F.avg(F.col("same").cast("double")), 6).alias("rate"))


@query(
    f"""WITH {E}, f AS (SELECT utt_id, op, ref_word, hyp_word, approx_time_s, bool_or(error_id % 2 = 0) AS flag FROM (SELECT utt_id, op, ref_word, hyp_word, approx_time_s, max(error_id) AS error_id FROM e GROUP BY ALL) GROUP BY ALL)
    SELECT error_id, coalesce(flag, false) AS flag FROM e LEFT JOIN f ON e.utt_id IS NOT DISTINCT FROM f.utt_id AND e.op IS NOT DISTINCT FROM f.op AND e.ref_word IS NOT DISTINCT FROM f.ref_word AND e.hyp_word IS NOT DISTINCT FROM f.hyp_word AND e.approx_time_s IS NOT DISTINCT FROM f.approx_time_s"""
)
def composite_key_join(spark: SparkSession, d: str) -> DataFrame:
    """Left join on a composite key in which NULL equals NULL; of repeated keys the last row wins, default false."""
    keys = ["utt_id", "op", "ref_word", "hyp_word", "approx_time_s"]
    e = errors(spark, d).select("error_id", *keys)
    flags = e.groupBy(*keys).agg((F.pmod(F.max("error_id"), F.lit(2)) == 0).alias("flag")).select(*[F.col(k).alias(f"_{k}") for k in keys], "flag")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return e.join(flags, on, "left").select("error_id", F.coalesce("flag", F.lit(False)).alias("flag"))


@query(f"WITH {U}, {SPANS} SELECT utt_id, dataset FROM u WHERE EXISTS (SELECT 1 FROM s WHERE s.key = {KEY.format('u.utt_id')})")
def annotated_semi(spark: SparkSession, d: str) -> DataFrame:
    annotated = table(spark, d, "phone_annotations").select(utterance_key(F.col("utt_id")).alias("key"))
    return utterances(spark, d).withColumn("key", utterance_key(F.col("utt_id"))).join(annotated, "key", "left_semi").select("utt_id", "dataset")
