"""Manifests, word sidecars, n-best caches, annotations, prompts, CSV logs and summaries."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "utt_id string, dataset string, wav_path string, text string, duration_s double, speaker string, accent string, cefr string, extra map<string,string>"
SIDECAR = "utt_id string, hyp_text string, words array<struct<w:string,start:double,end:double,prob:double>>"
PHONES = "utt_id string, phones array<struct<xmin:double,xmax:double,canonical:string,perceived:string,err_type:string>>"
ERRORS = "utt_id string, dataset string, condition string, op string, ref_word string, hyp_word string, ref_context string, ref_sentence string, hyp_sentence string, approx_time_s double, speaker string, accent string, why_category string, annotator_notes string, pattern_freq int"


def write_manifest(rows: DataFrame, path: str) -> DataFrame:
    """JSON lines; gives the rows written, to be counted or read on."""
    names = [x.split()[0] for x in MANIFEST.split(", ")]
    rows.select(*[n for n in names if n in rows.columns]).write.mode("overwrite").json(path)
    return rows


def read_manifest(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """JSON lines with the manifest's schema; blank lines are skipped, broken ones fail. Unless
    ``strict`` is off an unknown key fails too; that takes a pass of its own."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    if strict:
        known = [x.split()[0] for x in MANIFEST.split(", ")]
        keys = lines.select(F.explode(F.json_object_keys("value")).alias("k")).filter(~F.col("k").isin(known)).limit(1).collect()
        if keys:
            raise ValueError(f"unknown manifest key: {keys[0].k}")
    return lines.select(F.from_json("value", MANIFEST, {"mode": "FAILFAST"}).alias("u")).select("u.*")


def write_sidecars(rows: DataFrame, path: str) -> None:
    """Word timings, one folder for each condition."""
    rows.write.mode("overwrite").partitionBy("condition").json(path)


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Word timings; a missing probability is 0 and a missing text ''."""
    rows = spark.read.schema(SIDECAR + ", condition string").json(path)
    words = F.transform("words", lambda w: F.struct(w["w"].alias("w"), w["start"].alias("start"), w["end"].alias("end"), F.coalesce(w["prob"], F.lit(0.0)).alias("prob")))
    return rows.select("utt_id", F.coalesce("hyp_text", F.lit("")).alias("hyp_text"), words.alias("words"), "condition")


def write_nbest_cache(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows (utt_id, pos, hyp_id, text, acoustic) as lines {"utt_id", "hyps": [[text, score], ...]}.

    With mode 'append', lists that the cache holds already are left out."""
    if mode == "append":
        rows = rows.join(read_nbest_cache(rows.sparkSession, path), "utt_id", "left_anti")
    entry = F.concat(F.lit("["), F.regexp_extract(F.to_json(F.struct(F.col("text").alias("t"))), r"^\{\"t\":(.*)\}$", 1), F.lit(", "), F.col("acoustic").cast("string"), F.lit("]"))
    lists = rows.select("utt_id", F.struct("pos", "hyp_id", entry.alias("e")).alias("h")).groupBy("utt_id").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    name = F.regexp_extract(F.to_json(F.struct(F.col("utt_id").alias("t"))), r"^\{\"t\":(.*)\}$", 1)
    line = F.concat(F.lit('{"utt_id": '), name, F.lit(', "hyps": ['), F.array_join(F.transform("hs", lambda h: h["e"]), ", "), F.lit("]}"))
    lists.select(line.alias("value")).write.mode(mode).text(path)


def read_nbest_cache(spark: SparkSession, path: str) -> DataFrame:
    """(utt_id, hyps array<struct<pos, text, acoustic>>); of repeated ids the last line wins."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")).filter(F.trim("value") != "")
    raw = lines.select("file", "line", F.from_json("value", "utt_id string, hyps array<array<string>>").alias("r")).select("file", "line", "r.*")
    hyps = F.transform("hyps", lambda h, i: F.struct(i.alias("pos"), h[0].alias("text"), h[1].cast("double").alias("acoustic")))
    return raw.filter("utt_id IS NOT NULL").groupBy("utt_id").agg(F.max_by("hyps", F.struct("file", "line")).alias("hyps")).select("utt_id", hyps.alias("hyps"))


def write_phones(rows: DataFrame, path: str) -> None:
    """Phone annotations as JSON lines, with the fields of ``PHONES``."""
    span = lambda x: F.struct(*[x[c].alias(c) for c in ("xmin", "xmax", "canonical", "perceived", "err_type")])
    rows.select("utt_id", F.transform("phones", span).alias("phones")).write.mode("overwrite").json(path)


def read_phones(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PHONES).json(path)


def write_csv(rows: DataFrame, path: str, one_file: bool = False) -> None:
    """With a header; quotes are doubled and NULL differs from ''."""
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").options(header=True, escape='"', quoteAll=True, nullValue="\\N", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str = ERRORS) -> DataFrame:
    """With an explicit schema: nothing is inferred, so the words null and nan stay words."""
    return spark.read.schema(schema).options(header=True, multiLine=True, escape='"', nullValue="\\N", emptyValue="", nanValue="NaN", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_results(rows: DataFrame, path: str) -> None:
    """A result table as Parquet and as CSV, in two folders under ``path``. The CSV has flat columns only."""
    rows.write.mode("overwrite").parquet(f"{path}/parquet")
    write_csv(rows.select(*[c for c, kind in rows.dtypes if not kind.startswith(("array", "struct", "map", "binary"))]), f"{path}/csv")


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(sentence): stripped, empty lines dropped."""
    return spark.read.text(path).select(F.trim("value").alias("sentence")).filter("sentence <> ''")


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(sentence): the quoted text of lines ( id "text" ), else the whole line."""
    quoted = F.nullif(F.regexp_extract("value", r'\(\s*\S+\s+"(.+?)"\s*\)', 1), F.lit(""))
    return spark.read.text(path).select(F.coalesce(quoted, F.trim("value")).alias("sentence")).filter("sentence <> ''")


def write_summary(row: DataFrame, path: str) -> None:
    """A summary of one row as one JSON document."""
    row.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def speaker_files(spark: SparkSession, root: str, folder: str, suffix: str) -> DataFrame:
    """(speaker, stem, value): whole files <root>/<speaker>/<folder>/<stem>.<suffix>."""
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*.{suffix}")
    name = F.col("_metadata.file_path")
    at = rf"/([^/]+)/{folder}/([^/]+)\.{suffix}$"
    return rows.select(F.regexp_extract(name, at, 1).alias("speaker"), F.regexp_extract(name, at, 2).alias("stem"), "value").filter("speaker <> ''")


def archive_files(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """(archive, name, content): files with the suffix in every zip archive under ``root``, one archive a task at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in archive.namelist():
                        if name.endswith(f".{suffix}"):
                            yield pd.DataFrame({"archive": [path], "name": [name], "content": [archive.read(name)]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(root)
    return files.select("path", "content").mapInPandas(run, "archive string, name string, content binary")


def first_present(wanted: list[str], available: list[str]) -> str | None:
    """The first of the wanted columns that is there."""
    return next((c for c in wanted if c in available), None)


def probed(rows: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """The wanted columns, each from the first of its candidates that is there, NULL if none is."""
    found = {name: first_present(candidates, rows.columns) for name, candidates in wanted.items()}
    return rows.select(*[(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(name) for name, c in found.items()])


def without_heavy(rows: DataFrame, most: int = 32) -> DataFrame:
    """Without binary columns; lists and maps of more than ``most`` items become NULL."""

    def light(name: str, kind: str):
        c = F.col(f"`{name}`")
        return F.when(F.size(c) <= most, c).alias(name) if kind.startswith(("array", "map")) else c

    return rows.select(*[light(c, kind) for c, kind in rows.dtypes if kind != "binary"])


def markdown(rows: DataFrame, limit: int = 1000) -> str:
    """A small result as a Markdown table."""
    cells = [rows.columns, ["---"] * len(rows.columns), *[["" if v is None else str(v) for v in r] for r in rows.limit(limit).collect()]]
    return "\n".join("| " + " | ".join(r) + " |" for r in cells) + "\n"


