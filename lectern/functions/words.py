"""words(t): lower case, apostrophes and zero-width marks deleted, maximal runs of letters and digits.

Each form exists as a Column (JVM) and as a Python function for Arrow operators; they agree.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DELETED = "'’​﻿"
_DELETE = dict.fromkeys(map(ord, DELETED))
_RUN = re.compile(r"[^\W_]+")


def _plain(text: Column) -> Column:
    return F.translate(F.lower(text), DELETED, "")


def words(text: Column) -> Column:
    """Array of the words of ``text``; NULL for NULL."""
    return F.regexp_extract_all(_plain(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def joined_words(text: Column) -> Column:
    """The words with one blank between them; '' if there are none, NULL for NULL."""
    return F.trim(F.regexp_replace(_plain(text), r"[^\p{L}\p{N}]+", " "))


# ASCII text, the usual case, takes two passes in C: bytes that aren't letters or digits become blanks.
_ASCII = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(128)


def words_of(text: str) -> list[str]:
    if text.isascii():
        return text.encode().translate(_ASCII, b"'").decode().split()
    return _RUN.findall(text.lower().translate(_DELETE))


def joined_words_of(text: str) -> str:
    return " ".join(words_of(text))
