"""Phonetic likeness of two words: equal sound keys, or Jaro-Winkler similarity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOWELS = frozenset("aeiou")


def jaro_winkler(a: str, b: str, scale: float = 0.1, boost_over: float = 0.7) -> float:
    """Jaro similarity, raised by a common prefix of up to four letters if it is over ``boost_over``."""
    if a == b:
        return 1.0 if a else 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used = [False] * len(b)
    mine = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                mine.append(x)
                break
    if not mine:
        return 0.0
    theirs = [y for y, u in zip(b, used) if u]
    swaps = sum(x != y for x, y in zip(mine, theirs)) // 2
    n = len(mine)
    jaro = (n / len(a) + n / len(b) + (n - swaps) / n) / 3
    if jaro <= boost_over:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * scale * (1 - jaro)


def metaphone(word: str) -> str:
    """Metaphone key (Philips 1990) of a lower-case word; letters outside a-z are passed over."""
    w = "".join(c for c in word.lower() if "a" <= c <= "z")
    if w[:2] in ("kn", "gn", "pn", "wr", "ae"):
        w = w[1:]
    elif w[:1] == "x":
        w = "s" + w[1:]
    elif w[:2] == "wh":
        w = "w" + w[2:]
    at = lambda i: w[i] if 0 <= i < len(w) else ""
    key: list[str] = []
    skip = 0
    for i, c in enumerate(w):
        if skip:
            skip -= 1
            continue
        after, before = at(i + 1), at(i - 1)
        if c == before and c != "c":
            continue
        if c in _VOWELS:
            key += c.upper() if i == 0 else ""
        elif c == "b":
            key += "" if before == "m" and not after else "B"
        elif c == "c":
            if w[i : i + 3] == "cia" or (after == "h" and before != "s"):
                key += "X"
                skip = after == "h"
            elif after and after in "iey":
                key += "" if before == "s" else "S"
            else:
                key += "K"
                skip = after == "h"
        elif c == "d":
            edge = after == "g" and at(i + 2) in ("e", "i", "y")
            key += "J" if edge else "T"
            skip = edge
        elif c == "g":
            if after == "h" and not (i + 2 < len(w) and at(i + 2) not in _VOWELS):
                key += "K" if i == 0 else "F" if i + 2 >= len(w) else ""
                skip = 1
            elif after == "h" or after == "n":
                key += "" if after == "h" or i + 2 >= len(w) or w[i:] == "gned" else "K"
            else:
                key += "J" if after and after in "iey" and before != "g" else "K"
        elif c == "h":
            key += "H" if after in _VOWELS and after and before not in ("c", "s", "p", "t", "g") else ""
        elif c == "k":
            key += "" if before == "c" else "K"
        elif c == "p":
            key += "F" if after == "h" else "P"
            skip = after == "h"
        elif c == "q":
            key += "K"
        elif c == "s":
            if after == "h":
                key += "X"
                skip = 1
            else:
                key += "X" if w[i : i + 3] in ("sio", "sia") else "S"
        elif c == "t":
            if after == "h":
                key += "0"
                skip = 1
            elif w[i : i + 3] != "tch":
                key += "X" if w[i : i + 3] in ("tia", "tio") else "T"
        elif c == "v":
            key += "F"
        elif c in "wy":
            key += c.upper() if after in _VOWELS and after else ""
        elif c == "x":
            key += ["K", "S"]
        elif c == "z":
            key += "S"
        else:
            key += c.upper()
    return "".join(key)


def similar(a: str | None, b: str | None, least: float = 0.86) -> bool:
    """Different words with the same non-empty key, or at least so alike."""
    a, b = (a or "").lower(), (b or "").lower()
    if not a or not b or a == b:
        return False
    key = metaphone(a)
    return bool(key and key == metaphone(b)) or jaro_winkler(a, b) >= least


@F.pandas_udf(T.BooleanType())
def phonetic_similar(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([similar(x, y) for x, y in zip(a, b)], dtype=bool)


@F.pandas_udf(T.DoubleType())
def jaro_winkler_similarity(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b)], dtype=float)
