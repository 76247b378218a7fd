"""Vectorised word, shingle and batch helpers shared by the text operators.

Texts arrive as Arrow string columns. They are handled in chunks of bounded bytes; all hashing is numpy over
the raw UTF-8 bytes, so the cost is a few nanoseconds a byte and no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean table of 256: True for bytes inside one of the inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Separators of words ``[^\x20\x09-\x0D]+``.
WHITE = byte_class((0x20, 0x20), (0x09, 0x0D))
#: Separators of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, applied after A-Z are lower-cased.
NOT_ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 65536)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    up, down = _powers["up"][:n], _powers["down"][:n]
    if len(_powers["up"]) > 8 * CHUNK_BYTES:  # a single very long text: don't keep its tables
        _powers.clear()
    return up, down


def chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 texts) in runs of about ``max_bytes``; null is the empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False)) if len(column) else np.zeros(0)
    at = 0
    while at < len(column):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + max_bytes, "right")))
        yield at, column.slice(at, to - at).to_pylist()
        at = to


def join_texts(texts: list[bytes], sep: int = 0x20) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a separator byte after each text, and the position after each text's separator."""
    glue = bytes([sep])
    buffer = np.frombuffer(glue.join(texts) + glue, np.uint8)
    return buffer, np.cumsum([len(t) + 1 for t in texts])


def pieces(texts: list[bytes], separators: np.ndarray, fold: np.ndarray, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[list[int], list[bytes]]]:
    """(rows, parts) of at most about ``max_bytes``: long texts are cut at separators, so that no word is cut."""
    rows: list[int] = []
    parts: list[bytes] = []
    size = 0
    for r, t in enumerate(texts):
        at = 0
        while at < len(t):
            to = len(t)
            if to - at > max_bytes:
                to = at + max_bytes
                while to < len(t):  # on to the next separator, a window at a time
                    ahead = np.flatnonzero(separators[fold[np.frombuffer(t, np.uint8, min(4096, len(t) - to), to)]])
                    if len(ahead):
                        to += int(ahead[0])
                        break
                    to = min(to + 4096, len(t))
            rows.append(r)
            parts.append(t[at:to])
            size += to - at
            at = to
            if size >= max_bytes:
                yield rows, parts
                rows, parts, size = [], [], 0
    if parts:
        yield rows, parts


def words(texts: list[bytes], separators: np.ndarray, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """(row of each word, 64-bit hash of each word) in text order. Long texts are read part by part: 16 bytes a word stay."""
    found = [(np.asarray(rows)[row], value) for rows, parts in pieces(texts, separators, fold) for row, value in [_words(parts, separators, fold)]]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([r for r, _ in found]), np.concatenate([v for _, v in found])


def _words(texts: list[bytes], separators: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    buffer, ends = join_texts(texts)
    folded = fold[buffer]
    inside = ~separators[folded]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    start, stop = edges[::2], edges[1::2]
    up, down = _power_tables(len(buffer) + 1)
    total = np.cumsum(_BYTE_CODE[folded] * up[: len(buffer)], dtype=np.uint64)
    low = np.where(start > 0, total[start - 1], np.uint64(0))
    value = (total[stop - 1] - low) * down[start]
    return np.searchsorted(ends, start, "right"), mix(value + (stop - start).astype(np.uint64) * np.uint64(_BASE))


def grams(row: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every run of k words inside one row."""
    n = len(value) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out = out * np.uint64(_BASE) + value[at + j]
    return at, mix(out)


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of each text's distinct k-word shingles, sorted; fewer words: the whole sequence as one."""
    row, value = words(texts, WHITE)
    at, h = grams(row, value, k)
    r = row[at]
    count = np.bincount(row, minlength=len(texts))
    for m in range(1, k):
        short = np.flatnonzero(count[row] == m) if m in count else np.zeros(0, np.int64)
        if len(short):
            first = short[::m]
            out = np.full(len(first), m, np.uint64)
            for j in range(m):
                out = out * np.uint64(_BASE) + value[first + j]
            r, h = np.concatenate([r, row[first]]), np.concatenate([h, mix(out)])
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    if len(r):
        new = np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])])
        r, h = r[new], h[new]
    return r, h


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores in front as no column (in any case) has."""
    taken = {c.lower() for c in columns}
    mark = "_"
    while any(mark + n in taken for n in names):
        mark += "_"
    return [mark + n for n in names]
