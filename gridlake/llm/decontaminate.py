"""Benchmark decontamination by a prefix-filtered set join of item windows.

An item's windows are its runs of ``window`` words (a shorter item is one window). A text contains a window only if it
contains each of the window's shingles, so one necessary prefix token is enough to find it: its rarest shingle,
by a count over the whole corpus. Documents' shingles are joined on these tokens; the token's offset in the window
gives the only place where the window can lie, which must fit in the document (length and positional bounds), and
there all words are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from gridlake.functions.durable import durable
from gridlake.llm.text import NOT_ALNUM, chunks, fresh, grams, mix, words

WIDTH = 3
BLOCK_WINDOWS = 400_000
#: Blocks that pass over the documents in one scan.
SCAN_BLOCKS = 4
#: Bits of the filter of all benchmark shingles, and cells of the table of their counts in the corpus.
FILTER_BITS, COUNT_CELLS = 1 << 24, 1 << 18
_ADDED = ("n_words", "n_hit", "n_items", "items", "spans", "contaminated")


@dataclass
class Windows:
    """Distinct windows: words (n x window, zero-padded), lengths, and the items of each (cut[i]:cut[i+1] of items)."""

    words: np.ndarray
    length: np.ndarray
    cut: np.ndarray
    items: np.ndarray


@dataclass
class Index:
    """By shingle width: sorted prefix tokens, where each token's entries begin, and entries (window, offset)."""

    windows: Windows
    tokens: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def windows_of(ids: list[str], hashes: list[np.ndarray], window: int) -> Windows:
    """Windows of items given by their words' hashes."""
    starts, lengths, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    value = np.concatenate([np.zeros(0, np.uint64), *hashes])
    at = 0
    for i, n in enumerate(map(len, hashes)):
        if n:
            k = max(1, n - window + 1)
            starts.append(at + np.arange(k))
            lengths.append(np.full(k, min(n, window)))
            owners.append(np.full(k, i))
        at += n
    start, length, owner = map(np.concatenate, (starts, lengths, owners))
    table = np.zeros((len(start), window), np.uint64)
    for j in range(window):
        m = j < length
        table[m, j] = value[start[m] + j]
    keyed = np.concatenate([table, length[:, None].astype(np.uint64)], axis=1)
    distinct, inverse = np.unique(keyed, axis=0, return_inverse=True) if len(keyed) else (keyed, np.zeros(0, int))
    pairs = np.unique(np.stack([inverse.ravel(), owner], axis=1), axis=0) if len(owner) else np.zeros((0, 2), int)
    names = np.array(ids, dtype=object)
    return Windows(distinct[:, :window], distinct[:, window].astype(np.int64), np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)), names[pairs[:, 1].astype(int)])


def shingles_of(windows: Windows) -> dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """By width, for each offset: (windows that have it, offset, shingle)."""
    out: dict[int, list] = {}
    size = windows.words.shape[1]
    for n in range(1, size + 1):
        mine = np.flatnonzero(windows.length == n)
        width = min(n, WIDTH)
        for offset in range(n - width + 1 if len(mine) else 0):
            part = windows.words[mine, offset : offset + width]
            at, h = grams(np.repeat(np.arange(len(mine)), width), part.ravel(), width)
            out.setdefault(width, []).append((mine, np.full(len(mine), offset), h))
    return out


def build_index(windows: Windows, counts: np.ndarray) -> Index:
    """``counts``: by cell of a shingle, how often the corpus has shingles of it."""
    tokens = {}
    for width, parts in shingles_of(windows).items():
        window, offset, h = (np.concatenate(x) for x in zip(*parts, strict=True))
        rank = counts[_cell(h)]
        order = np.lexsort((offset, h, rank, window))
        rarest = order[np.concatenate([[True], window[order][1:] != window[order][:-1]])]
        by_token = rarest[np.argsort(h[rarest], kind="stable")]
        token, begin = np.unique(h[by_token], return_index=True)
        sieve = np.zeros(1 << 16, bool)
        sieve[(token & np.uint64(0xFFFF)).astype(int)] = True
        tokens[width] = token, np.append(begin, len(by_token)), window[by_token], offset[by_token], sieve
    return Index(windows, tokens)


def occurrences(row: np.ndarray, value: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence of a window in texts given as (row, word hash) sequences."""
    starts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for width, (token, begin, window, offset, sieve) in index.tokens.items():
        at, h = grams(row, value, width)
        maybe = np.flatnonzero(sieve[(h & np.uint64(0xFFFF)).astype(np.int64)])
        place = np.searchsorted(token, h[maybe])
        hit = place < len(token)
        hit[hit] = token[place[hit]] == h[maybe][hit]
        at, place = at[maybe[hit]], place[hit]
        n = begin[place + 1] - begin[place]
        entry = np.repeat(begin[place] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        anchor = np.repeat(at, n)
        w = window[entry]
        start = anchor - offset[entry]
        stop = start + index.windows.length[w]
        fits = (start >= 0) & (stop <= len(row))
        fits[fits] = (row[start[fits]] == row[anchor[fits]]) & (row[stop[fits] - 1] == row[anchor[fits]])
        start, w = start[fits], w[fits]
        for j in range(index.windows.words.shape[1]):
            inside = j < index.windows.length[w]
            same = ~inside
            same[inside] = value[start[inside] + j] == index.windows.words[w[inside], j]
            start, w = start[same], w[same]
        starts.append(start)
        found.append(w)
    return np.concatenate(starts), np.concatenate(found)


def _cell(shingle: np.ndarray) -> np.ndarray:
    return (shingle % np.uint64(COUNT_CELLS)).astype(np.int64)


def _bit(shingle: np.ndarray) -> np.ndarray:
    return (mix(shingle) % np.uint64(FILTER_BITS)).astype(np.int64)


def _count_shingles(documents: DataFrame, widths: set[int], wanted: np.ndarray) -> np.ndarray:
    """How often the whole corpus has shingles that pass the filter ``wanted``, by cell. One pass for all blocks; at most one number
    a cell and task moves, and only for cells in use."""
    sent = documents.sparkSession.sparkContext.broadcast((sorted(widths), np.packbits(wanted)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNT_CELLS, np.int64)
        widths, packed = sent.value
        passes = np.unpackbits(packed).view(bool)
        for batch in batches:
            for _, texts in chunks(batch.column("text")):
                row, value = words(texts, NOT_ALNUM)
                for width in widths:
                    _, g = grams(row, value, width)
                    counts += np.bincount(_cell(g[passes[_bit(g)]]), minlength=COUNT_CELLS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["cell", "n"])

    out = np.zeros(COUNT_CELLS, np.int64)
    for r in documents.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out


def _blocks(benchmark: DataFrame, window: int) -> Iterator[Windows]:
    """Windows of the items in blocks of at most BLOCK_WINDOWS, so that each block may be broadcast. Long items are cut."""
    ids: list[str] = []
    hashes: list[np.ndarray] = []
    room = BLOCK_WINDOWS
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), "text").where("i IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        _, value = words([r["text"].encode()], NOT_ALNUM)
        at, n = 0, max(1, len(value) - window + 1)
        while len(value) and at < n:
            k = min(room, n - at)
            ids.append(r["i"])
            hashes.append(value[at : at + k + window - 1])
            at, room = at + k, room - k
            if not room:
                yield windows_of(ids, hashes, window)
                ids, hashes, room = [], [], BLOCK_WINDOWS
    if ids:
        yield windows_of(ids, hashes, window)


def annotate(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """All columns of documents plus n_words, n_hit, n_items, items, spans and contaminated (own ones are replaced).

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased; null texts have none. ``spans`` has the
    merged word ranges as first, past the last, first, ... covered by occurrences of windows, n_hit their words, ``items`` the sorted ids
    (as strings) of items with an occurring window. Items without words or id match nothing; repeated rows of either table count
    as they stand; other columns, of any name, come through; an empty benchmark or table is no error.

    The benchmark is read twice by the driver, item by item, into blocks of BLOCK_WINDOWS windows. One pass over the documents counts
    the shingles of all blocks. Each block's index is broadcast (some 60 MB at most), and SCAN_BLOCKS of them pass over the
    documents in one scan, so nothing of them is shuffled; of a benchmark with more blocks (over 1.6 million windows) a durable table
    carries the hits from scan to scan.
    """
    keep = [c for c in documents.columns if c not in _ADDED]
    spans, items, n = fresh(documents.columns, "spans", "items", "n")
    wanted, widths = np.zeros(FILTER_BITS, bool), set()
    for windows in _blocks(benchmark, window):
        for width, parts in shingles_of(windows).items():
            widths.add(width)
            for _, _, h in parts:
                wanted[_bit(h)] = True
    counts = _count_shingles(documents, widths, wanted) if widths else np.zeros(COUNT_CELLS, np.int64)
    frame = documents.select(*keep)
    frame = frame.withColumns({spans: F.lit(None).cast("array<int>"), items: F.lit(None).cast("array<string>"), n: F.lit(0).cast("long")})
    done = 0
    for windows in _blocks(benchmark, window):
        if done and done % SCAN_BLOCKS == 0:
            frame = durable(frame)
        frame = _pass(frame, frame.sparkSession.sparkContext.broadcast(build_index(windows, counts)), spans, items, n)
        done += 1
    if not done:
        empty = windows_of([], [], window)
        frame = _pass(frame, frame.sparkSession.sparkContext.broadcast(build_index(empty, counts)), spans, items, n)
    sizes = f"aggregate(sequence(1, cast(size({spans}) div 2 as int)), 0L, (s, i) -> s + {spans}[2 * i - 1] - {spans}[2 * i - 2])"
    return frame.select(
        *keep,
        F.col(n).alias("n_words"),
        F.expr(f"if(size({spans}) = 0, 0L, {sizes})").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.array_sort(items).alias("items"),
        F.col(spans).alias("spans"),
        (F.size(spans) > 0).alias("contaminated"),
    )


def _pass(frame: DataFrame, sent: Broadcast, spans_name: str, items_name: str, n_name: str) -> DataFrame:
    names = frame.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            spans, items, n_words = [], [], []
            old_spans, old_items = batch.column(spans_name).to_pylist(), batch.column(items_name).to_pylist()
            for at, texts in chunks(batch.column("text")):
                row, value = words(texts, NOT_ALNUM)
                count = np.bincount(row, minlength=len(texts))
                first = np.cumsum(count) - count
                start, w = occurrences(row, value, index)
                of = row[start] if len(start) else start
                order = np.argsort(of, kind="stable")
                cut = np.searchsorted(of[order], np.arange(len(texts) + 1))
                n_words += count.tolist()
                for i in range(len(texts)):
                    mine = order[cut[i] : cut[i + 1]]
                    had, ids = old_spans[at + i] or [], set(old_items[at + i] or [])
                    if len(mine):
                        cover = np.zeros(count[i] + 1, np.int64)
                        np.add.at(cover, start[mine] - first[i], 1)
                        np.add.at(cover, start[mine] - first[i] + index.windows.length[w[mine]], -1)
                        for a, b in zip(had[::2], had[1::2], strict=True):
                            cover[a] += 1
                            cover[b] -= 1
                        inside = (np.cumsum(cover) > 0).astype(np.int8)
                        had = np.flatnonzero(np.diff(inside, prepend=np.int8(0))).tolist()
                        for x in np.unique(w[mine]).tolist():
                            ids.update(index.windows.items[index.windows.cut[x] : index.windows.cut[x + 1]])
                    spans.append(had)
                    items.append(sorted(ids))
            new = {spans_name: pa.array(spans, pa.list_(pa.int32())), items_name: pa.array(items, pa.list_(pa.string())), n_name: pa.array(n_words, pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names=names)

    return frame.mapInArrow(run, frame.schema)


def items_sha256() -> Column:
    """Digest of the matched item ids, comma-joined in string order."""
    return F.sha2(F.array_join("items", ","), 256)
