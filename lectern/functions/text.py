"""Normalisation and tokens for scoring: punctuation goes, apostrophes between letters stay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(text: Column) -> Column:
    """Lower case; all but letters, digits, '_', blanks and apostrophes between a-z become blanks; blanks collapse."""
    bare = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s']", " ")
    bare = F.regexp_replace(bare, "(?<![a-z])'|'(?![a-z])", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def tokens(text: Column) -> Column:
    """Tokens of the normalised text; an empty array if there are none, NULL for NULL."""
    return F.filter(F.split(normalize(text), " "), lambda t: t != "")


def context_frame(tokens_: Column, at: Column, width: int = 3) -> Column:
    """Up to ``width`` tokens on either side of the 0-based place ``at``, which stands in brackets; '' if ``at`` is NULL."""
    before = F.slice(tokens_, F.greatest(at - width + 1, F.lit(1)), F.least(at, F.lit(width)))
    after = F.slice(tokens_, at + 2, width)
    target = F.concat(F.lit("["), F.get(tokens_, at), F.lit("]"))
    return F.coalesce(F.array_join(F.concat(before, F.array(target), after), " "), F.lit(""))


def shorten(tokens_: Column, other: Column, keep: int = 3, longest: int = 7) -> Column:
    """Tokens that differ from ``other`` at their place in upper case; of more than ``longest`` the outer ``keep`` with an ellipsis."""
    marked = F.transform(tokens_, lambda t, i: F.when(F.get(other, i).eqNullSafe(t), t).otherwise(F.upper(t)))
    cut = F.concat(F.slice(marked, 1, keep), F.array(F.lit("…")), F.slice(marked, -keep, keep))
    return F.array_join(F.when(F.size(tokens_) > longest, cut).otherwise(marked), " ")
