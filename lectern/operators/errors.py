"""Error rows: derivation from aligned pairs, frequencies, categories, audits and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.distance import alignment
from lectern.functions.text import context_frame, tokens
from lectern.storage import stored

# Word lists that the category rules compare with.
SPELLINGS = [("centre", "center"), ("centres", "centers"), ("colour", "color"), ("favour", "favor"), ("honour", "honor"), ("labour", "labor"), ("theatre", "theater"), ("metre", "meter"), ("litre", "liter"), ("organise", "organize"), ("realise", "realize"), ("recognise", "recognize"), ("travelled", "traveled"), ("grey", "gray"), ("defence", "defense"), ("licence", "license"), ("practise", "practice"), ("programme", "program")]
COLLOQUIAL = [("em", "them"), ("til", "until"), ("cause", "because"), ("gonna", "going"), ("wanna", "want"), ("kinda", "kind"), ("ok", "okay")]
NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "twentieth"]
AUDITED_NUMBER_WORDS = ["hundred", "thousand", "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]

_JOIN = "\u0001"


def _low(word: Column) -> Column:
    return F.lower(F.coalesce(word, F.lit("")))


def _among(a: Column, b: Column, pairs: list[tuple[str, str]]) -> Column:
    """Whether the two are one of the pairs, in either order."""
    return F.concat(a, F.lit(_JOIN), b).isin([_JOIN.join(p) for x, y in pairs for p in ((x, y), (y, x))])


def is_number_form(ref: Column, hyp: Column) -> Column:
    a, b = _low(ref), _low(hyp)
    number = lambda w: w.rlike(r"\p{Nd}") | w.isin(NUMBER_WORDS)
    return number(a) & number(b) & (a != b)


def is_spelling(ref: Column, hyp: Column) -> Column:
    a, b = _low(ref), _low(hyp)
    stem = lambda w: F.when(F.length(w) > 2, F.substring(w, F.lit(1), F.length(w) - 2)).otherwise("")
    ends = lambda w: (F.length(w) > 3) & F.right(w, F.lit(2)).isin("re", "ur")
    return _among(a, b, SPELLINGS) | ((stem(a) == stem(b)) & (ends(a) | ends(b)))


def is_colloquial(ref: Column, hyp: Column) -> Column:
    bare = lambda w: F.trim(_low(w), F.lit("'"))
    return _among(bare(ref), bare(hyp), COLLOQUIAL)


def reference_truncated(ref: Column, hyp: Column) -> Column:
    """Whether the normalised reference stands within the normalised hypothesis, which has more words."""
    words = lambda t: F.size(F.filter(F.split(t, " "), lambda w: w != ""))
    return F.coalesce(F.contains(hyp, ref) & (words(hyp) > words(ref)), F.lit(False))


def classify(op: Column, ref: Column, hyp: Column, context: Column, coincides: Column, truncated: Column) -> Column:
    """The category of one error; the first rule that holds decides."""
    repeated = F.array_contains(F.regexp_extract_all(_low(context), F.lit("([a-z0-9']+)"), F.lit(1)), _low(hyp)) & (_low(hyp) != "")
    replaced = op == "substitute"
    return (
        F.when((op == "insert") & truncated, "reference_error")
        .when(replaced & is_colloquial(ref, hyp), "reference_error")
        .when(replaced & (is_number_form(ref, hyp) | is_spelling(ref, hyp)), "normalization")
        .when(coincides, "accent_phoneme")
        .when((op == "insert") & repeated, "disfluency")
        .when(op == "insert", "hallucination")
        .when(replaced, "model_lexical")
        .when(op == "delete", "deletion_other")
        .otherwise("other")
    )


def error_rows(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """One row for each edit: the pair's other columns, align_pos, op, words, places and ref_context.

    ``ref`` and ``hyp`` are token arrays. Only this explode needs Python, in Arrow batches.
    """
    ops = pairs.select("*", F.posexplode(alignment(F.col(ref), F.col(hyp))).alias("align_pos", "e"))
    return ops.select("*", "e.*", context_frame(F.col(ref), F.col("e.ref_idx")).alias("ref_context")).drop("e")


def with_word_time(errors: DataFrame, words: str, hyp_idx: str = "hyp_idx", out: str = "word_time_s") -> DataFrame:
    """The start of the error's hypothesis word; NULL for deletions. ``words`` holds the recogniser's words
    (w, start, ..), of which each may be several tokens, or none."""
    starts = F.flatten(F.transform(words, lambda w: F.transform(tokens(w["w"]), lambda _: w["start"])))
    return errors.withColumn(out, F.get(starts, F.col(hyp_idx)))


def with_error_time(errors: DataFrame, keys: list[str], order: list[str], time: str, out: str = "time_s") -> DataFrame:
    """An error without a time takes that of the error before it in ``order``, 0 at the start."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return errors.withColumn(out, F.coalesce(F.last(time, ignorenulls=True).over(w), F.lit(0.0)))


def pattern_frequency(errors: DataFrame) -> DataFrame:
    """(op, ref_word, hyp_word, n): NULL equals NULL. Aggregated, so a hot pattern is no hot task;
    join it back with ``with_pattern_frequency`` where each row needs it."""
    return errors.groupBy("op", "ref_word", "hyp_word").agg(F.count("*").alias("n"))


def with_pattern_frequency(errors: DataFrame, out: str = "n") -> DataFrame:
    """Each row with the frequency of its pattern. The counts of heavy patterns are broadcast and only the
    rows of the others are shuffled, so a hot pattern is no hot task."""
    counts = stored(pattern_frequency(errors), "pattern-counts")
    most = counts.agg(F.sum("n").alias("rows")).select((F.col("rows") / 1000).alias("_most"))
    # a pattern of a thousandth of all rows or more is heavy: there are a thousand of them at most
    heavy = counts.join(F.broadcast(most), F.col("n") >= F.col("_most")).select("op", "ref_word", "hyp_word", F.col("n").alias("_h"))
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in ("op", "ref_word", "hyp_word")]
    marked = errors.alias("e").join(F.broadcast(heavy).alias("h"), same("e", "h"), "left").select("e.*", "_h")
    light = marked.filter("_h IS NULL").drop("_h").alias("l").join(counts.alias("c"), same("l", "c")).select("l.*", F.col("c.n").alias(out))
    return marked.filter("_h IS NOT NULL").withColumnRenamed("_h", out).unionByName(light)


def coverage(patterns: DataFrame) -> DataFrame:
    """Patterns by frequency class with the share of all errors that frequent ones cover.

    The running sum is over the distinct frequencies, of which there are at most about
    sqrt(2 * errors), not over patterns."""
    by_n = patterns.groupBy("n").agg(F.count("*").alias("n_patterns"), F.sum("n").alias("n_errors"))
    running = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return by_n.select("n", "n_patterns", "n_errors", (F.sum("n_errors").over(running) / F.sum("n_errors").over(whole)).alias("covered"))


def agreement(pred: Column, truth: Column, times: Column | None = None) -> list[Column]:
    """Confusion counts, agreement, precision, recall, F1 and Cohen's kappa as aggregates; 0 where
    undefined. A row stands for ``times`` cases, by default for one."""
    count = lambda c: F.count_if(c) if times is None else F.coalesce(F.sum(F.when(c, times)), F.lit(0))
    tp, fp, fn, tn = count(pred & truth), count(pred & ~truth), count(~pred & truth), count(~pred & ~truth)
    n = (tp + fp + fn + tn).cast("double")
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    precision, recall, po = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tp + tn, n)
    pe = ratio((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    return [
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), F.bround(po, 3).alias("agreement"), F.bround(precision, 3).alias("precision"), F.bround(recall, 3).alias("recall"),
        F.bround(ratio(2 * precision * recall, precision + recall), 3).alias("f1"), F.bround(ratio(po - pe, 1 - pe), 3).alias("kappa"),
    ]


def rule_holds(category: Column, op: Column, ref: Column, hyp: Column, context: Column) -> Column:
    """Whether a label satisfies the rule that defines its category, as far as text shows it."""
    a, b = _low(ref), _low(hyp)
    return (
        F.when(category == "accent_phoneme", op.isin("substitute", "delete") & (a != ""))
        .when(category == "hallucination", op.isin("insert", "substitute") & (b != "") & ~F.contains(_low(context), b))
        .when(category == "normalization", F.concat(a, b).rlike(r"\p{Nd}") | a.isin(AUDITED_NUMBER_WORDS) | b.isin(AUDITED_NUMBER_WORDS))
        .when(category == "model_lexical", op.isin("substitute", "delete", "insert"))
        .when(category == "deletion_other", op == "delete")
        .otherwise(F.lit(True))
    )
