"""P6: fill containers of fixed capacity with items, by bounded-space online packing.

1. Each task reads documents, sizes them with a public tokenizer and keeps ``open_windows`` open
   windows. An item goes to the window it fills best; if none has room, the fullest window is
   emitted and a new one opened. Only an item longer than the capacity is split: into full windows
   and one rest, which is packed like any item.
2. At its end a task has at most ``open_windows`` windows left. These leftovers, not the items
   already emitted, are shuffled to fewer tasks and packed again, until few enough remain that one
   task's open windows are a small share of all; then they are emitted.

State is one bounded list of windows a task and never a group of documents. Leftovers are put in
the order of their ids before they are packed, so a task that is run again gives the same windows.

Defined results: documents with NULL or empty text, or no id, hold no token and are in no window;
repeated ids are packed as further items; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import base64
import bisect
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from lectern.storage import stored

#: Splits text before the merges of the rank files (fixed value of the vocabulary's publisher).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_PIECES = "window string, doc_id long, piece int, piece_start long, n_tokens int, window_start int, fill int, is_open boolean"
_TYPES = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
_NAMES = [x.split()[0] for x in _PIECES.split(", ")]


#: Bytes of a vocabulary file; it is sent to the executors whole.
MAX_VOCABULARY = 64 << 20


def vocabulary(path: str) -> bytes:
    """A rank file, read on the driver; its size is checked, for it is broadcast."""
    if os.path.getsize(path) > MAX_VOCABULARY:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY} bytes")
    with open(path, "rb") as file:
        return file.read()


def token_counter(ranks: bytes):
    """A function that gives a text's number of tokens."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


class OpenWindows:
    """At most ``limit`` open windows; best fit by bisection over their room."""

    def __init__(self, capacity: int, limit: int) -> None:
        self.capacity, self.limit = capacity, limit
        self.room: list[int] = []  # ascending
        self.items: list[list] = []

    def add(self, size: int, item) -> tuple[int, list] | None:
        """Places an item; gives (fill, items) of a window that had to be emitted or became full."""
        at = bisect.bisect_left(self.room, size)
        out = None
        if at < len(self.room):
            room, items = self.room.pop(at), self.items.pop(at)
        else:
            if len(self.room) >= self.limit:
                out = (self.capacity - self.room.pop(0), self.items.pop(0))
            room, items = self.capacity, []
        items.append(item)
        room -= size
        if room == 0 and out is None:
            return self.capacity, items
        at = bisect.bisect_left(self.room, room)
        self.room.insert(at, room)
        self.items.insert(at, items)
        return out

    def rest(self) -> list[tuple[int, list]]:
        return [(self.capacity - r, i) for r, i in zip(self.room, self.items)]


def _rows(prefix: str, number: int, fill: int, items: list, is_open: bool) -> list[tuple]:
    out, at = [], 0
    for doc, piece, start, n in items:
        out.append((f"{prefix}-{number}", doc, piece, start, n, at, fill, is_open))
        at += n
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)


def _pack(prefix: str, capacity: int, limit: int, sized, keep_open: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = f"{prefix}{TaskContext.get().partitionId()}"
        windows, number, out = OpenWindows(capacity, limit), 0, []
        for item in sized(batches):
            done = windows.add(item[3], item)
            if done:
                out += _rows(task, number, *done, False)
                number += 1
            if len(out) > 20_000:
                yield _batch(out)
                out = []
        for fill, items in windows.rest():
            out += _rows(task, number, fill, items, keep_open)
            number += 1
        yield _batch(out)

    return run


def _sized_documents(capacity: int, ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        count = token_counter(ranks.value)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = count(text)
                for piece, start in enumerate(range(0, n, capacity)):
                    yield doc, piece, start, min(capacity, n - start)

    return run


def _sized_leftovers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(4)))


def pack(documents: DataFrame, capacity: int = 2048, open_windows: int = 64, tokenizer: str = TOKENIZER, merge_windows: int = 4096) -> DataFrame:
    """(window, doc_id, piece, piece_start, n_tokens, window_start, fill): every document's pieces.

    ``fill`` is the number of tokens in the window; a merging task takes about ``merge_windows``
    leftover windows, at least four times ``open_windows``.
    """
    texts = documents.filter("doc_id IS NOT NULL AND text <> ''").select(F.col("doc_id").cast("long"), "text")
    ranks = documents.sparkSession.sparkContext.broadcast(vocabulary(tokenizer))
    level = stored(texts.mapInArrow(_pack("p", capacity, open_windows, _sized_documents(capacity, ranks), True), _PIECES), "windows-0")
    done = [level.filter("NOT is_open")]
    number = 0
    # each level leaves at most open_windows of merge_windows windows open, a quarter or less
    merge_windows = max(merge_windows, 4 * open_windows)
    while True:
        number += 1
        leftover = level.filter("is_open")
        n = leftover.select("window").distinct().count()
        if not n:
            break
        tasks = -(-n // merge_windows)
        last = tasks == 1
        placed = leftover.select("doc_id", "piece", "piece_start", "n_tokens").repartition(tasks, F.xxhash64("doc_id", "piece")).sortWithinPartitions(F.desc("n_tokens"), "doc_id", "piece", "piece_start")
        # items come longest first: best fit decreasing
        level = stored(placed.mapInArrow(_pack(f"m{number}-", capacity, open_windows, _sized_leftovers, not last), _PIECES), f"windows-{number}")
        done.append(level.filter("NOT is_open"))
        if last:
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.drop("is_open")
