"""P7: held-out passages inside a training corpus, by a distributed positional inverted index.

1. ``positional_index`` stores the postings of every token of the corpus once. The index is cut by
   document into segments of about ``SEGMENT_TOKENS`` tokens, each one row: its terms, and for each term the
   documents that hold it with their positions. All lists of a document are in one segment, so lists
   are intersected where they are, nothing is shuffled, and a term in every document is spread over all
   segments. Any number of item sets and of searches use one index.
2. A search first adds up the lengths of the lists of the items' terms. For each window of ``run`` words
   of an item the ``probes`` terms with the shortest lists are chosen: the list of the rarest, adjusted by
   its offset, is intersected with those of the next ones; what is left are alignments (document,
   item, offset) at which some window holds all its rarest terms.
3. At these alignments the lists of all terms of the item are looked up, and consecutive positions are put
   together into runs: those of ``run`` words or more are exact phrase matches.
4. Proximity matches probe the rarer terms of each window of 24 words; where a few stand near their places
   relative to each other all terms of the window are looked up, and half of them must be there,
   whether or not as a phrase: so every phrase match is a proximity match too. Documents that hold half
   of a whole item's rarest terms in that way match as well.

Held-out items are a fixed query set; they are taken in blocks of ``block_words`` words, and only
a block's words are sent to the executors. Documents are read whole.

Defined results: NULL ids and texts take no part; items and documents under ``run`` words match
nothing; repeated ids are united; empty tables give empty results. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.words import words_of

SEGMENT_TOKENS = 100_000
#: Parquet options for the index: rows are large, and writer and reader hold a row group's rows at once.
STORAGE = {"parquet.block.row.count.limit": 4}
#: doc_ids, lengths: of the segment's documents. sizes: of each term's list of (document, number of
#: positions), the lists of all terms one after another in docs and counts, and their positions.
_INDEX = "doc_ids array<long>, lengths array<int>, terms array<string>, sizes array<int>, docs array<int>, counts array<int>, positions array<int>"


def _segment(ids: list[int], texts: list[list[str]]) -> pa.RecordBatch:
    lengths = np.array([len(ws) for ws in texts], np.int32)
    coded = pa.array(list(chain.from_iterable(texts)), pa.string()).dictionary_encode()
    term = coded.indices.to_numpy()
    order = np.argsort(term, kind="stable")  # by term, document and position
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
    place = np.arange(len(term), dtype=np.int32) - np.repeat(np.cumsum(lengths, dtype=np.int32) - lengths, lengths)
    term, doc, place = term[order], doc[order], place[order]
    first = np.flatnonzero(np.concatenate((np.ones(len(term[:1]), bool), (np.diff(term) != 0) | (np.diff(doc) != 0))))
    columns = [
        pa.array(ids, pa.int64()), lengths, coded.dictionary, np.bincount(term[first], minlength=len(coded.dictionary)).astype(np.int32),
        doc[first], np.diff(np.append(first, len(term))).astype(np.int32), place,
    ]
    one = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c if isinstance(c, pa.Array) else pa.array(c)) for c in columns]
    return pa.RecordBatch.from_arrays(one, names=[x.split()[0] for x in _INDEX.split(", ")])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list[int] = []
    texts: list[list[str]] = []
    n = 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ws = words_of(text.as_py())
            if ids and n + len(ws) > SEGMENT_TOKENS:
                yield _segment(ids, texts)
                ids, texts, n = [], [], 0
            ids.append(doc)
            texts.append(ws)
            n += len(ws)
    if ids:
        yield _segment(ids, texts)


def positional_index(documents: DataFrame) -> DataFrame:
    """The index of documents (doc_id, text), one row a segment; to be stored, once for all searches."""
    rows = documents.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_segments, _INDEX)


def _blocks(items: DataFrame, block_words: int) -> Iterator[dict[int, list[list[str]]]]:
    """The items' words in blocks of about ``block_words``; an id may have several texts."""
    block: dict[int, list[list[str]]] = {}
    n = 0
    for r in items.filter("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").toLocalIterator():
        ws = words_of(r.text)
        block.setdefault(r.item_id, []).append(ws)
        n += len(ws)
        if n >= block_words:
            yield block
            block, n = {}, 0
    if block:
        yield block


def _coded(block: dict[int, list[list[str]]], least: int) -> tuple[list[tuple[int, list[int]]], dict[str, int]]:
    """([(item, its terms)], vocabulary) of the block's texts of ``least`` words or more."""
    vocabulary: dict[str, int] = {}
    return [(item, [vocabulary.setdefault(w, len(vocabulary)) for w in ws]) for item, texts in block.items() for ws in texts if len(ws) >= least], vocabulary


def _values(batch: pa.RecordBatch, name: str, row: int):
    return batch.column(name)[row].values


def _lengths(index: DataFrame, vocabulary) -> dict[int, int]:
    """The posting lists' lengths: at most one row for each term of the block."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(vocabulary.value), np.int64)
        known = pa.array(vocabulary.value, pa.string())
        for batch in batches:
            for row in range(batch.num_rows):
                code = pc.fill_null(pc.index_in(_values(batch, "terms", row), known), -1).to_numpy()
                n[code[code >= 0]] += _values(batch, "sizes", row).to_numpy()[code >= 0]
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], names=["term", "n"])

    found = index.select("terms", "sizes").mapInArrow(sums, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r.term: r.n for r in found.collect()}


class _Postings:
    """A segment's lists of the terms of a block: term, document and position, and the same by place."""

    def __init__(self, batch: pa.RecordBatch, row: int, known: pa.Array) -> None:
        values = lambda name: _values(batch, name, row)
        self.doc_ids, self.lengths = values("doc_ids").to_numpy(), values("lengths").to_numpy().astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        code = pc.fill_null(pc.index_in(values("terms"), known), -1).to_numpy()
        sizes, counts = values("sizes").to_numpy(), values("counts").to_numpy()
        of = np.repeat(code, sizes)
        wanted = of >= 0
        self.term = np.repeat(of[wanted], counts[wanted])
        self.doc = np.repeat(values("docs").to_numpy()[wanted], counts[wanted])
        self.place = values("positions").to_numpy()[np.repeat(wanted, counts)].astype(np.int64)
        self.by_place = np.full(int(self.lengths.sum()), -1, np.int32)
        self.by_place[self.starts[self.doc] + self.place] = self.term

    def stands(self, doc: np.ndarray, place: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Whether the lists of the terms hold these places."""
        inside = (place >= 0) & (place < self.lengths[doc])
        out = np.zeros(len(place), bool)
        out[inside] = self.by_place[self.starts[doc[inside]] + place[inside]] == term[inside]
        return out


def _of_segments(find, vocabulary):
    """An Arrow operator that gives ``find`` the postings of each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary.value, pa.string())
        for batch in batches:
            for row in range(batch.num_rows):
                yield from find(_Postings(batch, row, known))

    return run


def _phrases(coded: list[tuple[int, list[int]]], lengths: dict[int, int], n_terms: int, run: int, probes: int, at_once: int = 1_000_000):
    """A function from a segment's postings to phrase matches."""
    windows: set[tuple[int, ...]] = set()
    begin = np.cumsum([0, *(len(ts) for _, ts in coded)])
    for part, (_, ts) in enumerate(coded):
        for s in range(len(ts) - run + 1):
            rarest = sorted(range(s, s + run), key=lambda q: (lengths.get(ts[q], 0), q))[:probes]
            if lengths.get(ts[rarest[0]], 0):
                windows.add((part, *rarest))
    if not windows:
        return None
    items = np.array([item for item, _ in coded], np.int64)
    term_of = np.array([t for _, ts in coded for t in ts], np.int32)
    w = np.array(sorted(windows), np.int64)
    part_of, q_of = w[:, 0], w[:, 1:]
    probe = term_of[begin[part_of][:, None] + q_of]
    order = np.argsort(probe[:, 0], kind="stable")
    part_of, q_of, probe = part_of[order], q_of[order], probe[order]
    low = np.searchsorted(probe[:, 0], np.arange(n_terms + 1))
    size = np.diff(begin)

    def find(x: _Postings) -> Iterator[pa.RecordBatch]:
        some = np.flatnonzero(low[x.term + 1] > low[x.term])
        fan = low[x.term[some] + 1] - low[x.term[some]]
        found = [np.zeros((3, 0), np.int64)]
        ends = np.searchsorted(np.cumsum(fan), np.arange(at_once, int(fan.sum()) + at_once, at_once), side="left") + 1
        for a, b in zip([0, *ends], ends):
            if a >= b:
                continue
            of, k = _spread(low[x.term[some[a:b]]], fan[a:b])
            doc, diag = x.doc[some[a:b]][of], x.place[some[a:b]][of] - q_of[k, 0]
            for j in range(1, q_of.shape[1]):
                good = x.stands(doc, diag + q_of[k, j], probe[k, j])
                doc, diag, k = doc[good], diag[good], k[good]
            found.append(np.unique(np.stack((doc, part_of[k], diag)), axis=1))
        doc, part, diag = np.unique(np.concatenate(found, 1), axis=1)
        of, o = _spread(begin[part], size[part])
        q = o - begin[part][of]
        same = x.stands(doc[of], diag[of] + q, term_of[o])
        # a run starts where a word stands and the word before it in the item does not
        start = np.flatnonzero(same & ((q == 0) | ~np.concatenate(([False], same[:-1]))))
        stop = np.flatnonzero(same & (np.concatenate((q[1:] == 0, [True])) | ~np.concatenate((same[1:], [False]))))
        n = stop - start + 1
        start, n = start[n >= run], n[n >= run].astype(np.int32)
        if len(n):
            a = of[start]
            columns = [x.doc_ids[doc[a]], items[part[a]], (diag[a] + q[start]).astype(np.int32), q[start].astype(np.int32), n]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "item_id", "doc_start", "item_start", "n_words"])

    return find


def phrase_matches(index: DataFrame, items: DataFrame, run: int = 12, probes: int = 3, block_words: int = 500_000) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_words): every run of ``run`` or more common words."""
    spark = index.sparkSession
    schema = "doc_id long, item_id long, doc_start int, item_start int, n_words int"
    out = [spark.createDataFrame([], schema)]
    for block in _blocks(items, block_words):
        coded, vocabulary = _coded(block, run)
        if not coded:
            continue
        words = spark.sparkContext.broadcast(list(vocabulary))  # of at most about block_words words
        find = _phrases(coded, _lengths(index, words), len(vocabulary), run, probes)
        if find:
            out.append(index.mapInArrow(_of_segments(find, words), schema).distinct())
    return reduce(DataFrame.unionByName, out)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, value) of all values of the ranges starts .. starts + sizes."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[of]


def _distinct(x: np.ndarray) -> np.ndarray:
    """The values in order; a sort is faster here than np.unique's hash table."""
    x = np.sort(x)
    return x[np.concatenate((np.ones(len(x[:1]), bool), x[1:] != x[:-1]))]


def _finder(coded: list[tuple[int, list[int]]], lengths: dict[int, int], n_terms: int, window: int, probes: int | None, slop: int, share: float, piece: int, sure: int = 5):
    """A function (row, place, term) -> (row, part, n_terms, n_probes) of tokens in pieces, whose
    rows ascend and whose places are below ``piece``.

    With ``probes``, ``share`` of a window's so many rarest terms must stand within ``slop`` of each
    other's places. Without, ``share`` of all its terms must; then at least ``sure`` of all but the
    most frequent ones do, which are probed first, and the others are looked up at such places."""
    probe_term, probe_place, first_term, of_window, needs, sizes, spans, begin = [], [], [], [], [], [], [], [0]
    for _, ts in coded:
        chosen, first = set(), set()
        for s in range(max(1, len(ts) - window + 1)):
            places = range(s, min(s + window, len(ts)))
            size = min(probes or window, len(places))  # terms without postings are missed ones
            need = max(1, math.ceil(size * share))
            rarest = sorted((q for q in places if lengths.get(ts[q], 0)), key=lambda q: (lengths[ts[q]], q))[:size]
            if len(rarest) < need:
                continue
            if not probes:
                rarest, need = rarest[: len(rarest) - need + min(sure, need)], min(sure, need)
            chosen.update(rarest)
            first.update(rarest[: len(rarest) - need + 1])  # a match holds one of these
            of_window += [(begin[-1] + q, len(needs)) for q in rarest]
            needs.append(need)
            sizes.append(size)
            spans.append((begin[-1] + s, len(places)))
        for q in sorted(chosen):
            probe_term.append(ts[q])
            probe_place.append(begin[-1] + q)
            first_term.append(q in first)
        begin.append(begin[-1] + len(ts))
    if not needs:
        return None
    least = min(needs)
    term, place, is_first = np.array(probe_term, np.int64), np.array(probe_place, np.int64), np.array(first_term, bool)
    order = np.argsort(term, kind="stable")
    place, is_first, term = place[order], is_first[order], term[order]
    low = np.searchsorted(term, np.arange(n_terms + 1))
    windows_of = np.array(sorted(of_window), np.int64)
    begin_of = np.array(begin, np.int64)
    part_of = np.searchsorted(begin_of, place, side="right") - 1
    shift_of = begin_of[part_of] - place + begin[-1]  # diagonals aren't negative
    low_window = np.searchsorted(windows_of[:, 0], np.arange(begin[-1] + 1))
    need_of, size_of = np.array(needs, np.int64), np.array(sizes, np.int64)
    start_of, length_of = np.array(spans, np.int64).T
    term_of = np.array([t for _, ts in coded for t in ts], np.int64)
    n_parts, zero = len(coded), begin[-1]

    def found(row: np.ndarray, p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, ...]:
        some = low[t + 1] > low[t]
        row_of, p_of, t_of = row[some], p[some], t[some]
        of, k = _spread(low[t_of], low[t_of + 1] - low[t_of])
        # rarest first: only pairs with a hit of a window's first terms
        pair = row_of[of] * n_parts + part_of[k]
        alive = np.zeros((row[-1] + 1) * n_parts, bool)
        alive[pair[is_first[k]]] = True
        diag = p_of[of] + shift_of[k]
        n_diags = piece + zero + slop + 1
        n_bands, n_places = n_diags // (2 * slop) + 2, zero + 1
        # bands whose hashed cell has too few hits go before anything is sorted
        may = np.zeros(len(k), bool)
        cell = pair * n_bands
        for shift in (0, slop):  # two bands, half a band apart: places within slop share one of them
            in_cell = (cell + (diag + shift) // (2 * slop)) & (2**18 - 1)
            may |= (np.bincount(in_cell, minlength=2**18) >= least)[in_cell]
        may = np.flatnonzero(may)
        may = may[alive[pair[may]]]
        pair, diag, k = pair[may], diag[may], k[may]
        hit = _distinct((pair * n_diags + diag) * n_places + place[k])
        rest, q = np.divmod(hit, n_places)
        pair, diag = np.divmod(rest, n_diags)
        kept = np.zeros(len(hit), bool)
        for shift in (0, slop):
            group = pair * n_bands + (diag + shift) // (2 * slop)
            order = np.argsort(group * n_places + q)
            g, o = group[order], q[order]
            j = np.arange(max(0, len(hit) - least + 1))
            j = j[(g[j] == g[j + least - 1]) & (o[j + least - 1] - o[j] < window)] if least > 1 else j
            # a place that stands twice in a band counts twice here; what follows is exact
            kept[order[_spread(j, np.full(len(j), least))[1]]] = True
            twice = np.flatnonzero((g[1:] == g[:-1]) & (o[1:] == o[:-1]))
            kept[order[twice]] = kept[order[twice + 1]] = True
        pair, diag, q = pair[kept], diag[kept], q[kept]
        # each hit as the least one: the window's probed terms that stand up to slop words further on
        key = pair * n_diags + diag  # ascending
        low_key = np.searchsorted(key, key)
        i, j = _spread(low_key, np.searchsorted(key, key + slop, side="right") - low_key)
        close = (pair[i] == pair[j]) & (np.abs(q[i] - q[j]) < window)
        i, j = i[close], j[close]
        of_hit, w = _spread(low_window[q[j]], low_window[q[j] + 1] - low_window[q[j]])
        w = windows_of[w, 1]
        inside = (start_of[w] <= q[i[of_hit]]) & (q[i[of_hit]] < start_of[w] + length_of[w])
        found_at = _distinct((key[i[of_hit]][inside] * len(need_of) + w[inside]) * zero + q[j[of_hit]][inside] - start_of[w[inside]])
        at, n = np.unique(found_at // zero, return_counts=True)
        key, w = np.divmod(at, len(need_of))
        good = n >= need_of[w]
        (pair, diag), w, n = np.divmod(key[good], n_diags), w[good], n[good]
        if probes:
            return pair // n_parts, pair % n_parts, n, size_of[w]
        # all terms of the window: first those within slop of that hit, then exactly
        token = _distinct((row * n_terms + t) * n_diags + p)

        def standing(pair: np.ndarray, w: np.ndarray, least_diag: np.ndarray, width: int) -> np.ndarray:
            of, o = _spread(start_of[w], length_of[w])
            here, part = np.divmod(pair[of], n_parts)
            at = least_diag[of] - zero + o - begin_of[part]
            base = (here * n_terms + term_of[o]) * n_diags
            slot = np.searchsorted(token, base + np.maximum(0, at))
            stands = (at + width >= 0) & (slot < len(token)) & (token[np.minimum(slot, len(token) - 1)] <= base + np.minimum(at + width, n_diags - 1))
            return np.bincount(of, stands, len(w)).astype(np.int64)

        enough = np.ceil(size_of[w] * share)
        good = standing(pair, w, diag - slop, 2 * slop) >= enough
        pair, w, diag, enough = pair[good], w[good], diag[good], enough[good]
        n = np.max([standing(pair, w, diag - d, slop) for d in range(slop + 1)], axis=0)
        good = n >= enough
        return pair[good] // n_parts, pair[good] % n_parts, n[good], size_of[w[good]]

    return found


def _near(coded: list[tuple[int, list[int]]], lengths: dict[int, int], n_terms: int, window: int, item_probes: int, slop: int, share: float, piece: int = 2048, at_once: int = 4_000):
    """A function from a segment's postings to proximity matches. Documents are taken in pieces of ``piece``
    places, overlapping by more than a match can span, and about ``at_once`` tokens at a time."""
    longest = max(len(ts) for _, ts in coded)
    reach = longest + 3 * slop
    finders = [f for w, probes in ((window, None), (longest, item_probes)) if (f := _finder(coded, lengths, n_terms, w, probes, slop, share, piece + reach))]
    items = np.array([item for item, _ in coded], np.int64)

    def near(x: _Postings) -> Iterator[pa.RecordBatch]:
        docs, ps, ts, n = [], [], [], 0

        def batch():
            row = np.repeat(np.arange(len(ps)), [len(p) for p in ps])
            p, t = np.concatenate(ps), np.concatenate(ts)
            r, part, n_found, n_probes = (np.concatenate(x) for x in zip(*(f(row, p, t) for f in finders)))
            columns = [np.array(docs, np.int64)[r], items[part], n_found.astype(np.int32), n_probes.astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "item_id", "n_terms", "n_probes"])

        for doc, begin, length in zip(x.doc_ids.tolist(), x.starts.tolist(), x.lengths.tolist()):
            of = x.by_place[begin : begin + length]
            for a in range(0, length, piece):
                cut = of[a : a + piece + reach]
                p = np.flatnonzero(cut >= 0)
                if len(p):
                    docs.append(doc)
                    ps.append(p)
                    ts.append(cut[p].astype(np.int64))
                    n += len(p)
                if n >= at_once:
                    yield batch()
                    docs, ps, ts, n = [], [], [], 0
        if n:
            yield batch()

    return near if finders else None


def proximity_matches(index: DataFrame, items: DataFrame, run: int = 6, item_probes: int = 8, slop: int = 8, share: float = 0.5, block_words: int = 500_000, window: int = 24) -> DataFrame:
    """(doc_id, item_id, n_terms, n_probes): at least ``share`` of the terms of some ``window`` words
    of an item, or of its ``item_probes`` rarest terms, stand within ``slop`` words of their places
    relative to each other; the numbers are those of the window with most. A run of half a window
    is a match. Items under ``run`` words match nothing, those under ``window`` are one window."""
    spark = index.sparkSession
    schema = "doc_id long, item_id long, n_terms int, n_probes int"
    out = [spark.createDataFrame([], schema)]
    for block in _blocks(items, block_words):
        coded, vocabulary = _coded(block, run)
        if not coded:
            continue
        words = spark.sparkContext.broadcast(list(vocabulary))  # of at most about block_words words
        near = _near(coded, _lengths(index, words), len(vocabulary), window, item_probes, slop, share)
        if near:
            rows = index.mapInArrow(_of_segments(near, words), schema)
            out.append(rows.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_terms", "n_probes")).alias("m")).select("doc_id", "item_id", "m.n_terms", "m.n_probes"))
    return reduce(DataFrame.unionByName, out)
