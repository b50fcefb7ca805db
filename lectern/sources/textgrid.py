"""Interval tiers of TextGrid files in their long and short form."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TIERS = "path string, tier string, pos int, xmin double, xmax double, text string"
_ITEM = re.compile(r'class\s*=\s*"(\w+)"\s*name\s*=\s*"((?:[^"]|"")*)"')
_INTERVAL = re.compile(r'xmin\s*=\s*(\S+)\s*xmax\s*=\s*(\S+)\s*text\s*=\s*"((?:[^"]|"")*)"')


def decode(content: bytes) -> str:
    """UTF-16 with a byte order mark, else UTF-8, else Latin-1."""
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return content.decode("utf-16", errors="replace")
    try:
        return content.decode("utf-8-sig")
    except UnicodeError:
        return content.decode("latin-1")


def _long(text: str) -> Iterator[tuple]:
    heads = list(_ITEM.finditer(text))
    for head, after in zip(heads, [*heads[1:], None]):
        if head[1] == "IntervalTier":
            body = text[head.end() : after.start() if after else len(text)]
            for pos, m in enumerate(_INTERVAL.finditer(body)):
                yield head[2].replace('""', '"'), pos, float(m[1]), float(m[2]), m[3].replace('""', '"').strip()


def _short(text: str) -> Iterator[tuple]:
    """Values stand on lines of their own; a tier ends with its size, the file, or the first broken interval."""
    lines = iter([x.strip() for x in text.splitlines()])
    bare = lambda x: x[1:-1].replace('""', '"') if len(x) > 1 and x[0] == x[-1] == '"' else x
    for line in lines:
        if line != '"IntervalTier"':
            continue
        try:
            name = bare(next(lines))
            next(lines), next(lines)
            for pos in range(int(float(next(lines)))):
                lo, hi = float(next(lines)), float(next(lines))
                yield name, pos, lo, hi, bare(next(lines)).strip()
        except (StopIteration, ValueError):
            continue


def parse(text: str) -> list[tuple]:
    """(tier, pos, xmin, xmax, text) of every interval."""
    return list(_long(text) if "intervals [" in text or "intervals:" in text else _short(text))


def read_textgrids(spark: SparkSession, path: str) -> DataFrame:
    """Every interval of every TextGrid file under ``path``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *x) for p, c in zip(batch["path"], batch["content"]) for x in parse(decode(c))]
            yield pd.DataFrame(rows, columns=["path", "tier", "pos", "xmin", "xmax", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.TextGrid").load(path)
    return files.select("path", "content").mapInPandas(run, TIERS)


def phone_label(text: Column) -> Column:
    """struct(canonical, perceived, err_type) of a label "canonical,perceived,tag"; a plain label is a correct phone."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x))
    marked = F.size(parts) >= 3
    return F.struct(parts[0].alias("canonical"), F.when(marked, F.get(parts, F.lit(1))).otherwise(parts[0]).alias("perceived"), F.when(marked, F.lower(F.get(parts, F.lit(2)))).otherwise("").alias("err_type"))


def phone_annotations(intervals: DataFrame) -> DataFrame:
    """(path, phones) of the tier phones, or else phone; empty labels are dropped."""
    tier = intervals.filter(F.col("tier").isin("phones", "phone") & (F.trim("text") != ""))
    span = F.struct("pos", F.round("xmin", 4).alias("xmin"), F.round("xmax", 4).alias("xmax"), phone_label(F.col("text")).alias("l"))
    by = tier.groupBy("path", "tier").agg(F.array_sort(F.collect_list(span)).alias("s"))
    best = by.groupBy("path").agg(F.max_by("s", "tier").alias("s"))  # 'phones' before 'phone'
    return best.select("path", F.transform("s", lambda x: F.struct(x["xmin"].alias("xmin"), x["xmax"].alias("xmax"), x["l"]["canonical"].alias("canonical"), x["l"]["perceived"].alias("perceived"), x["l"]["err_type"].alias("err_type"))).alias("phones"))
