"""P1: frequency of every distinct term, in rows and in records, by heavy-light aggregation.

1. Heavy terms and heavy records are detected over all rows: every partition reports its most
   frequent raw values, the sums of these reports are cut to ``max_heavy`` per field. Detection
   only routes work; no count depends on it.
2. Rows are placed by record, so that a record's repeated terms meet in one task. The rows of a
   heavy record, and those without a record, are dealt over all tasks by row id (by their values
   where that is missing, too), so that repeated deliveries of a row still meet.
3. Each task reads its rows in the order of record, row id and arrival, with bounded state. It counts
   the heavy terms, known to it by broadcast, in exact local counter arrays and sends one row for each
   heavy term it saw. All other terms are pre-aggregated and shuffled by term. Where a record is
   spread over tasks or over pieces of the task's input its distinct (term, record) pairs are sent
   instead, and made distinct again before they are counted.
4. The two count tables have no term in common and are united.

Defined results: NULL values and values without a word aren't counted; a NULL record adds to a
term's rows but to no count of records; rows without a row id are each one row; of rows with the
same record and row id the earliest by ``arrived`` counts (of those the least by its values).
An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.words import joined_words_of
from lectern.storage import stored

HEAVY, LIGHT, PAIR, RECORDS, HEAVY_PAIR = 0, 1, 2, 3, 4
CHUNK_ROWS = 200_000
_PARTS = "kind int, field int, term string, record string, n_rows long, n_records long"


def _reports(fields: int, top: int):
    """Raw values that are frequent in a partition: field index (-1: the record), value, rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[dict] = [{} for _ in range(fields + 1)]
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for at in range(fields + 1):
                counted = pc.value_counts(batch.column(at).drop_null())
                mine = sums[at]
                for value, n in zip(counted.field(0).to_pylist(), counted.field(1).to_pylist()):
                    mine[value] = mine.get(value, 0) + n
                if len(mine) > 200_000:  # keeps memory bounded; routing needs no exact counts
                    sums[at] = dict(sorted(mine.items(), key=lambda x: -x[1])[:50_000])
        out = []
        for at, mine in enumerate(sums):
            least = max(2, rows // 1000 if at < fields else rows // 100)
            best = sorted(((n, v) for v, n in mine.items() if n >= least), reverse=True)[:top]
            out += [(at if at < fields else -1, v, n) for n, v in best]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int32(), pa.string(), pa.int64()))],
            names=["field", "value", "n"],
        )

    return run


def _detect(rows: DataFrame, fields: int, max_heavy: int) -> tuple[list[list[str]], list[str]]:
    found = (
        rows.select(*[f"v{i}" for i in range(fields)], "record")
        .mapInArrow(_reports(fields, max_heavy), "field int, value string, n long")
        .groupBy("field", "value")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"))
        .limit(max_heavy * (fields + 1))
        .collect()
    )
    terms: list[dict[str, None]] = [{} for _ in range(fields)]
    for r in found:
        if r.field >= 0 and (term := joined_words_of(r.value)):
            terms[r.field].setdefault(term)
    return [list(t)[:max_heavy] for t in terms], [r.value for r in found if r.field < 0][:max_heavy]


def _terms_of(column: pa.ChunkedArray, cache: dict) -> tuple[np.ndarray, list[str]]:
    """(code of each row's term or -1, the terms)."""
    column = column.combine_chunks().dictionary_encode()
    raw = column.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    terms: dict[str, int] = {}
    local = []
    for value in column.dictionary.to_pylist():
        term = cache.get(value)
        if term is None:
            if len(cache) > 500_000:
                cache.clear()
            term = cache[value] = joined_words_of(value)
        local.append(terms.setdefault(term, len(terms)) if term else -1)
    return np.where(raw >= 0, np.array([*local, -1])[raw], -1), list(terms)


class _Counts:
    """What a task carries from chunk to chunk: the counter arrays, the last row and an unfinished record."""

    def __init__(self, fields: int, heavy: list[dict[str, int]], hot: frozenset) -> None:
        self.fields, self.heavy, self.hot = fields, heavy, hot
        self.cache: list[dict] = [{} for _ in range(fields)]
        self.rows = [np.zeros(len(h), np.int64) for h in heavy]
        self.recs = [np.zeros(len(h), np.int64) for h in heavy]
        self.records = 0
        self.last: tuple | None = None  # (record, row id) of the last row
        self.open: str | None = None  # a record whose rows were cut; its pairs were sent

    def add(self, table: pa.Table, more: bool) -> Iterator[tuple]:
        """Adds the rows of a chunk; ``more`` tells that others follow. Yields light counts and pairs."""
        record = table.column("record").combine_chunks().dictionary_encode()
        names = record.dictionary.to_pylist()
        size = len(names) + 1
        codes = record.indices.fill_null(len(names)).to_numpy(zero_copy_only=False).astype(np.int64)
        known = table.column("row_id").is_valid().to_numpy()
        ids = table.column("row_id").fill_null(0).to_numpy()
        keep = np.ones(len(codes), bool)
        keep[1:] = ~((codes[1:] == codes[:-1]) & known[1:] & known[:-1] & (ids[1:] == ids[:-1]))
        ends = [(names[codes[k]] if codes[k] < len(names) else None, int(ids[k]) if known[k] else None) for k in (0, -1)]
        if ends[0][1] is not None and ends[0] == self.last:  # this row was the last of the chunk before
            keep[: int(keep[1:].argmax()) + 1 if keep[1:].any() else len(keep)] = False
        # records whose pairs must meet those of other tasks or chunks
        apart = np.array([n in self.hot or n == self.open for n in names] + [False])
        if self.open is not None and ends[0][0] != self.open:
            self.open = None
        started = {n for n in names if n not in self.hot and n != self.open}
        if more and ends[1][0] is not None:
            apart[codes[-1]] = True
            self.open = ends[1][0]
        self.last = ends[1]
        self.records += len(started)
        codes = codes[keep]
        for f in range(self.fields):
            code, words = _terms_of(table.column(f"v{f}"), self.cache[f])
            code = code[keep]
            used = code >= 0
            if not used.any():
                continue
            code, who = code[used], codes[used]
            slot = np.array([self.heavy[f].get(w, -1) for w in words])
            split = apart[who]
            pair, n_rows = np.unique(code[split] * size + who[split], return_counts=True)
            for p, n in zip(pair, n_rows):
                t = p // size
                yield PAIR if slot[t] < 0 else HEAVY_PAIR, f, words[t], names[p % size], int(n), 0
            code, who = code[~split], who[~split]
            n_rows = np.bincount(code, minlength=len(words))
            distinct = np.unique(code[who < len(names)] * size + who[who < len(names)])
            n_records = np.bincount(distinct // size, minlength=len(words))
            at = slot >= 0
            np.add.at(self.rows[f], slot[at], n_rows[at])
            np.add.at(self.recs[f], slot[at], n_records[at])
            for i in np.flatnonzero(~at & (n_rows > 0)):
                yield LIGHT, f, words[i], None, int(n_rows[i]), int(n_records[i])

    def heavy_rows(self) -> Iterator[tuple]:
        for f in range(self.fields):
            for term, i in self.heavy[f].items():
                if self.rows[f][i]:
                    yield HEAVY, f, term, None, int(self.rows[f][i]), int(self.recs[f][i])


def _count(fields: int, heavy_terms, hot_records: list[str]):
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        columns = list(zip(*rows)) if rows else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in _PARTS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(fields, [{t: i for i, t in enumerate(terms)} for terms in heavy_terms.value], frozenset(hot_records))
        out: list[tuple] = []
        held: list[pa.RecordBatch] = []
        rows = 0
        batches = (b for b in batches if b.num_rows)
        b = next(batches, None)
        while b is not None:
            held.append(b)
            rows += b.num_rows
            b = next(batches, None)
            if b is None or rows >= CHUNK_ROWS:
                out += counts.add(pa.Table.from_batches(held), b is not None)
                held, rows = [], 0
                for i in range(0, len(out), 50_000):
                    yield batch(out[i : i + 50_000])
                out = []
        yield batch([*counts.heavy_rows(), (RECORDS, -1, None, None, 0, counts.records)])

    return run


def term_frequencies(
    rows: DataFrame, fields: list[str], record: str, row_id: str, arrived: str | None = None, rare_below: int = 3, common_over: float = 0.02, max_heavy: int = 1024, record_salts: int | None = None
) -> DataFrame:
    """(field, term, n_rows, n_records, mark) for every distinct term of ``fields``.

    mark is 'rare' if fewer than ``rare_below`` records hold the term, 'common' if more than the
    share ``common_over`` of all distinct records do, else NULL. A heavy record is dealt over
    ``record_salts`` tasks, by default over as many as a shuffle has.
    """
    n = len(fields)
    spark = rows.sparkSession
    values = [f"v{i}" for i in range(n)]
    narrow = rows.select(
        *[rows[f].cast("string").alias(v) for f, v in zip(fields, values)],
        rows[record].cast("string").alias("record"),
        rows[row_id].cast("long").alias("row_id"),
        *([rows[arrived].alias("arrived")] if arrived else []),
    )
    heavy, hot = _detect(narrow, n, max_heavy)
    salts = record_salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = F.col("record").isNull() | (F.col("record").isin(hot) if hot else F.lit(False))
    dealt = F.when(F.col("row_id").isNotNull(), F.xxhash64("row_id")).otherwise(F.xxhash64(*values))
    salt = F.when(spread, F.pmod(dealt, F.lit(salts))).otherwise(0)
    placed = narrow.repartition(F.col("record"), salt).sortWithinPartitions("record", "row_id", *(["arrived"] if arrived else []), *values)
    inputs = placed.select(*values, "record", "row_id")
    parts = stored(inputs.mapInArrow(_count(n, spark.sparkContext.broadcast(heavy), hot), _PARTS), "term-parts", ["kind"])
    of = lambda kind: parts.filter(F.col("kind") == kind)
    sums = [F.sum("n_rows").alias("n_rows"), F.sum("n_records").alias("n_records")]

    def counted(whole: int, pairs: int) -> DataFrame:
        """Counts of one table, those of records that were spread included."""
        own = of(pairs).groupBy("field", "term", "record").agg(F.sum("n_rows").alias("n_rows")).select("field", "term", "n_rows", F.lit(1).cast("long").alias("n_records"))
        return of(whole).select("field", "term", "n_rows", "n_records").unionByName(own).groupBy("field", "term").agg(*sums)

    counts = counted(HEAVY, HEAVY_PAIR).unionByName(counted(LIGHT, PAIR))
    records = (of(RECORDS).agg(F.sum("n_records").alias("n")).first().n or 0) + len(hot)
    name = F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("field") + 1)
    mark = F.when(F.col("n_records") < rare_below, "rare").when(F.col("n_records") > math.floor(round(common_over * records, 9)), "common")
    return counts.select(name.alias("field"), "term", "n_rows", "n_records", mark.alias("mark"))
