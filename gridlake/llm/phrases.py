"""Phrase collocations by best-first branch and bound.

A phrase is two to five words inside a piece of text; its score is 1000 * a * n / (l * r) at its worst cut, rounded down. As the rest
after a cut occurs at least a times, no phrase that begins or ends with a word of frequency f scores above 1000 * n / f. So nodes
of the search are phrases, an expansion counts a node's one-word continuations, and a node's bound comes from the count of its first
word: words of the highest bounds (the rarest) are expanded first. A wave of expansions gives each language surviving phrases; their
2000th score then tells which nodes can still matter: all whose bound reaches it, which the next wave expands. A language is settled
when the bounds of all nodes left are below its 2000th surviving score, so ties are complete too. Within a wave, phrases are settled
(all their parts counted, and whether a longer phrase has as many occurrences) in order of their bounds, too, and only as far as needed.

Texts are read twice: to count words, and to write them as sequences of word hashes with breaks at piece ends and at words too rare for any
phrase. All later counts run over these sequences. Which nodes to count is told to the tasks by a bitmap of hashed nodes, whose size is
bounded; nodes that it lets through by chance are dropped by exact joins. Counts are summed in the tasks before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridlake.functions.durable import Workspace
from gridlake.llm import text
from gridlake.llm.text import LOWER, byte_class, chunks, mix

LONGEST = 5
PIECE_END = byte_class((0x0A, 0x0D), *[(b, b) for b in b".,;:!?"])
GAP = byte_class((0x20, 0x20), (0x09, 0x09)) | PIECE_END
#: Words of a sequence row; a longer piece is one row.
ROW_WORDS = 256
STEP_WORDS = 1 << 17
HELD_ROWS = 1 << 18
LEAST_BITS, MOST_BITS = 20, 28
FIRST_SHARE = 0.25
#: Contenders that are settled at first, as a multiple of the phrases that are asked for.
SETTLED = 2
_WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]
_COUNTS = [f"f{i}" for i in range(1, LONGEST + 1)]
_BASE = np.uint64(0x9E3779B97F4A7C55)


def _codes(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed) * np.uint64(0xA0761D6478BD642F))


def tokenize(texts: list[bytes], seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, starts, ends, hashes, pieces) of the words of all texts; the piece of a word is a number that rises from piece to piece."""
    buffer, _ = text.join_texts(texts, 0x0A)
    folded = LOWER[buffer]
    edges = np.flatnonzero(np.diff((~GAP[folded]).view(np.int8), prepend=np.int8(0)))
    start, stop = edges[::2], edges[1::2]
    up, down = text._power_tables(len(buffer) + 1)
    h = _hashed(folded, start, stop, up, down, _codes(seed))
    h[h == 0] = 1
    return folded, start, stop, h, np.cumsum(PIECE_END[folded])[start]


def _hashed(folded: np.ndarray, start: np.ndarray, stop: np.ndarray, up: np.ndarray, down: np.ndarray, codes: np.ndarray) -> np.ndarray:
    total = np.cumsum(codes[folded] * up[: len(folded)], dtype=np.uint64)
    low = np.where(start > 0, total[start - 1], np.uint64(0))
    return mix((total[stop - 1] - low) * down[start] + (stop - start).astype(np.uint64) * _BASE)


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """(language, texts) of about a chunk's bytes each, cut at piece ends only."""
    column = batch.column("lang").fill_null("und").dictionary_encode()
    where = column.indices.to_numpy(zero_copy_only=False)
    for code, lang in enumerate(column.dictionary.to_pylist()):
        for _, some in chunks(batch.column("text").take(pa.array(np.flatnonzero(where == code)))):
            for _, parts in text.pieces(some, PIECE_END, LOWER):
                yield lang, parts


class Tally:
    """Counts of keys (rows of long columns) with the least and largest of further columns, merged when there are many."""

    def __init__(self, lows: int = 0) -> None:
        self.lows, self.parts, self.rows = lows, [], 0

    def add(self, order_by: np.ndarray, keys: list[np.ndarray], count: np.ndarray, low: list[np.ndarray] = (), high: list[np.ndarray] = ()) -> None:
        """``order_by`` is a hash of the key; rows of one hash but different keys may stay apart, which only costs rows."""
        if len(order_by):
            self.parts.append(self._merged(order_by, keys, count, low, high))
            self.rows += len(self.parts[-1][0])

    def _merged(self, order_by, keys, count, low, high) -> tuple:
        order = np.argsort(order_by, kind="stable")
        order_by, keys = order_by[order], [k[order] for k in keys]
        new = np.ones(len(order), bool)
        new[1:] = order_by[1:] != order_by[:-1]
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        first = np.flatnonzero(new)
        return order_by[first], [k[first] for k in keys], np.add.reduceat(count[order], first), [np.minimum.reduceat(x[order], first) for x in low], [np.maximum.reduceat(x[order], first) for x in high]

    def full(self) -> bool:
        """Whether many rows are left after merging what was added."""
        if self.rows <= HELD_ROWS:
            return False
        self.parts = [self._all()]
        self.rows = len(self.parts[0][0])
        return self.rows > HELD_ROWS // 2

    def _all(self) -> tuple:
        a = self.parts
        joined = lambda i: [np.concatenate([p[i][j] for p in a]) for j in range(len(a[0][i]))]
        return self._merged(np.concatenate([p[0] for p in a]), joined(1), np.concatenate([p[2] for p in a]), joined(3), joined(4))

    def take(self, names: list[str], languages: list[str]) -> Iterator[pa.RecordBatch]:
        """What was counted, as rows of language (the first key is its number), keys, count and extremes; the tally is empty then."""
        if self.parts:
            _, keys, count, low, high = self._all()
            lang = pa.DictionaryArray.from_arrays(pa.array(keys[0].astype(np.int32)), pa.array(languages, pa.string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([lang, *[pa.array(k.view(np.int64)) for k in keys[1:]], pa.array(count), *[pa.array(x.view(np.int64)) for x in (*low, *high)]], names=names)
        self.parts, self.rows = [], 0


def _count_words(documents: DataFrame, seed: int) -> DataFrame:
    """(lang, h, g, c): words as hashes h with a second hash g, so that words that share an h are noticed; h = 0 counts all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, names, number = Tally(), ["lang", "h", "g", "c"], {}
        for batch in batches:
            for lang, parts in _by_language(batch):
                folded, start, stop, h, _ = tokenize(parts, seed)
                up, down = text._power_tables(len(folded) + 1)
                g = _hashed(folded, start, stop, up, down, _codes(seed + 1_000_003))
                of = np.full(len(h) + 1, number.setdefault(lang, len(number)), np.uint64)
                h, g = np.append(h, np.uint64(0)), np.append(g, np.uint64(0))
                count = np.ones(len(h), np.int64)
                count[-1] = len(h) - 1
                tally.add(h + of, [of, h, g], count)
                if tally.full():
                    yield from tally.take(names, list(number))
        yield from tally.take(names, list(number))

    return documents.select("lang", "text").mapInArrow(run, "lang string, h long, g long, c long")


def _language_hash(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _on(p: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(p * _BASE + w)


class Nodes:
    """A bitmap of hashed phrases (lang, w1...): those of a table, and few others. It has some 32 bits a phrase, 32 MB at most."""

    def __init__(self, table: DataFrame, columns: list[str]) -> None:
        n = table.count()
        bits = min(MOST_BITS, max(LEAST_BITS, (32 * n).bit_length()))
        self.mask = (1 << bits) - 1
        mask = self.mask

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = np.array([_language_hash(x) for x in batch.column("lang").to_pylist()], np.uint64)
                for i, c in enumerate(columns):
                    w = batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64)
                    p = _on(p, w) if i == 0 else np.where(w == 0, p, _on(p, w))
                p = (p & np.uint64(mask)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(p >> 15), pa.array(p & 32767)], names=["bucket", "bit"])

        rows = table.select("lang", *columns).mapInArrow(run, "bucket long, bit long").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
        whole = np.zeros(max((1 << bits) // 8, 4096), np.uint8)
        for r in rows.toLocalIterator():  # 4 KB each, 8192 of them at most
            whole[4096 * r["bucket"] : 4096 * (r["bucket"] + 1)] = np.frombuffer(bytes(r["bits"]), np.uint8)
        self.sent: Broadcast = table.sparkSession.sparkContext.broadcast(whole)

    def reader(self):
        """A function for tasks: which of these hashes may be nodes."""
        sent, mask = self.sent, np.uint64(self.mask)

        def has(p: np.ndarray) -> np.ndarray:
            at = (p & mask).astype(np.int64)
            return (sent.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

        return has

    def forget(self) -> None:
        self.sent.unpersist()


def _encode(documents: DataFrame, words: Nodes, seed: int) -> DataFrame:
    """(lang, codes): sequences of word hashes as bytes; 0 stands for a piece's end and for runs of words that are no nodes."""
    has = words.reader()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, rows = [], []
            for name, parts in _by_language(batch):
                _, _, _, h, piece = tokenize(parts, seed)
                if not len(h):
                    continue
                h = np.where(has(_on(np.full(len(h), _language_hash(name)), h)), h, np.uint64(0))
                breaks = np.flatnonzero(np.diff(piece)) + 1
                h = np.insert(h, breaks, 0)
                h = h[(h != 0) | np.append(True, h[:-1] != 0)]
                ends = np.flatnonzero(h == 0)
                at = 0
                while at < len(h):
                    to = ends[min(np.searchsorted(ends, at + ROW_WORDS), len(ends) - 1)] if len(ends) and ends[-1] >= at + ROW_WORDS else len(h)
                    lang.append(name)
                    rows.append(h[at:to].tobytes())
                    at = to
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(rows, pa.binary())], names=["lang", "codes"])

    return documents.select("lang", "text").mapInArrow(run, "lang string, codes binary")


def _sequences(batch: pa.RecordBatch, number: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word hashes, number of the language, hash of the language) of some STEP_WORDS at a time, rows set apart by zeros."""
    column = batch.column("lang").dictionary_encode()
    names = column.dictionary.to_pylist()
    hashes = np.array([_language_hash(x) for x in names], np.uint64)
    numbers = np.array([number.setdefault(x, len(number)) for x in names], np.uint64)
    where, rows = column.indices.to_numpy(zero_copy_only=False), batch.column("codes")
    ends = np.cumsum(np.diff(np.frombuffer(rows.buffers()[1], np.int32, len(rows) + 1, 4 * rows.offset)) // 8 + 1)
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP_WORDS, "right")))
        some = rows.slice(at, to - at).to_pylist()
        w = np.frombuffer(bytes(8).join(some) + bytes(8), np.uint64)
        of = np.repeat(where[at:to], [len(x) // 8 + 1 for x in some])
        yield w, numbers[of], hashes[of]
        at = to


def _expand(sequences: DataFrame, nodes: Nodes, m: int) -> DataFrame:
    """(lang, w1, ... of m + 1 words, c): continuations by one word of the phrases of m words that may be nodes."""
    has, names = nodes.reader(), ["lang", *_WORDS[: m + 1], "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, number = Tally(), {}
        for batch in batches:
            for w, of, p in _sequences(batch, number):
                at = np.flatnonzero(w)
                p = _on(p[at], w[at])
                for j in range(1, m + 1):
                    if j == m:
                        near = has(p)
                        at, p = at[near], p[near]
                    near = w[at + j] != 0  # a sequence ends in zeros, so this stays inside
                    at = at[near]
                    p = _on(p[near], w[at + j])
                tally.add(p, [of[at], *[w[at + j] for j in range(m + 1)]], np.ones(len(at), np.int64))
                if tally.full():
                    yield from tally.take(names, list(number))
        yield from tally.take(names, list(number))

    found = sequences.mapInArrow(run, ", ".join(["lang string", *[f"{c} long" for c in names[1:]]]))
    return found.groupBy(*names[:-1]).agg(F.sum("c").alias("a"))


def _context(sequences: DataFrame, nodes: Nodes) -> DataFrame:
    """(lang, w1 to w5, a, inside): counts of the phrases that may be nodes; inside says whether all occurrences follow or precede one and the same word."""
    has, ends = nodes.reader(), ["before_low", "after_low", "before_high", "after_high"]
    names = ["lang", *_WORDS, "c", *ends]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, number = Tally(), {}
        for batch in batches:
            for w, of, p in _sequences(batch, number):
                at = np.flatnonzero(w)
                p = _on(p[at], w[at])
                for j in range(1, LONGEST):
                    near = w[at + j] != 0
                    at = at[near]
                    p = _on(p[near], w[at + j])
                    hit = has(p)
                    i = at[hit]
                    none = np.zeros(len(i), np.uint64)
                    before = np.where(i > 0, w[i - 1], np.uint64(0))
                    words = [w[i + k] if k <= j else none for k in range(LONGEST)]
                    tally.add(p[hit], [of[i], *words], np.ones(len(i), np.int64), [before, w[i + j + 1]], [before, w[i + j + 1]])
                    if tally.full():
                        yield from tally.take(names, list(number))
        yield from tally.take(names, list(number))

    found = sequences.mapInArrow(run, ", ".join(["lang string", *[f"{c} long" for c in names[1:]]]))
    # extremes of unsigned numbers as signed ones: equal extremes of one task stay equal, and so do those of all
    low = [F.min(F.least(f"{e}_low", f"{e}_high")).alias(f"{e}_low") for e in ("before", "after")]
    high = [F.max(F.greatest(f"{e}_low", f"{e}_high")).alias(f"{e}_high") for e in ("before", "after")]
    rows = found.groupBy("lang", *_WORDS).agg(F.sum("c").alias("a"), *low, *high)
    alone = lambda e: (F.col(f"{e}_low") == F.col(f"{e}_high")) & (F.col(f"{e}_low") != 0)
    return rows.select("lang", *_WORDS, "a", ((alone("before") | alone("after")) & (F.col("w5") == 0)).alias("inside"))


def _spelled(documents: DataFrame, words: Nodes, seed: int) -> DataFrame:
    """(lang, h, word) of the words that may be nodes."""
    has = words.reader()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            out = []
            for lang, parts in _by_language(batch):
                folded, start, stop, h, _ = tokenize(parts, seed)
                at = np.flatnonzero(has(_on(np.full(len(h), _language_hash(lang)), h)))
                for i in at[np.unique(h[at], return_index=True)[1]].tolist():
                    key = lang, int(h[i])
                    if key not in seen:
                        seen.add(key)
                        out.append((*key, folded[start[i] : stop[i]].tobytes().decode()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array(np.array([o[1] for o in out], np.uint64).view(np.int64)), pa.array([o[2] for o in out], pa.string())], names=["lang", "h", "word"])

    return documents.select("lang", "text").mapInArrow(run, "lang string, h long, word string").groupBy("lang", "h").agg(F.min("word").alias("word"))


def _ratio(n: Column, top: list[Column], bottom: list[Column]) -> Column:
    """floor(1000 * n * top / bottom), exactly: products are decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(20,0)")
    product = lambda cs: cs[0] if len(cs) == 1 else (cs[0] * cs[1]).cast("decimal(38,0)")
    return F.call_function("div", product([wide(1000 * n), *map(wide, top)]).cast("decimal(38,0)"), product([*map(wide, bottom)]).cast("decimal(38,0)"))


def _levels(sequences: DataFrame, first: DataFrame, least: int, tables: Workspace) -> DataFrame | None:
    """Phrases of two words and more (lang, m, w1 to w5, f1 to f5) whose first word is in ``first`` (lang, w1, f1): f1, f2, ... count the first word, two words, ..."""
    level, found = first, None
    for m in range(1, LONGEST):
        words = _WORDS[:m]
        nodes = Nodes(level, words)
        grown = _expand(sequences, nodes, m).where(F.col("a") >= least).join(level, ["lang", *words])
        level = tables.durable(grown.select("lang", *_WORDS[: m + 1], *_COUNTS[:m], F.col("a").alias(_COUNTS[m])))
        nodes.forget()
        if level.isEmpty():
            break
        none = [F.lit(0).cast("long").alias(c) for c in (*_WORDS[m + 1 :], *_COUNTS[m + 1 :])]
        same = level.select("*", *none).select("lang", F.lit(m + 1).alias("m"), *_WORDS, *_COUNTS)
        found = same if found is None else found.union(same)
    return found


def _wave(sequences: DataFrame, words: DataFrame, limits: DataFrame, top_k: int, least: int, tables: Workspace) -> DataFrame | None:
    """Surviving phrases (lang, m, w1 to w5, a, l, r, n, score), complete down to the language's ``top_k``-th score for all that begin and end with
    words of at most ``top`` occurrences (limits: lang, n, top, score) and whose score reaches the language's ``score``.

    Contenders are settled best first: at the start those with the highest bounds, SETTLED * top_k of each language. Where the score that is then in place
    top_k isn't above the bounds of all others, those with bounds from that score on are settled too (or, without such a score, four times as many)."""
    first = tables.durable(words.join(limits, "lang").where("f <= top").select("lang", F.col("h").alias("w1"), F.col("f").alias("f1")))
    grown = _levels(sequences, first, least, tables)
    if grown is None:
        return None
    ends = words.select("lang", F.col("h").alias("last"), F.col("f").alias("f_last"))
    grown = grown.withColumn("last", _at(_WORDS, F.col("m"))).withColumn("a", _at(_COUNTS, F.col("m"))).join(ends, ["lang", "last"]).join(limits, "lang").where("f_last <= top")
    bound = F.least(_ratio(F.col("n"), [], [F.col("f1")]), _ratio(F.col("n"), [F.col("a")], [_at(_COUNTS, F.col("m") - 1), F.col("f_last")]))
    contenders = grown.withColumn("bound", bound).where("bound >= score").select("lang", "m", *_WORDS, *_COUNTS, "a", "f_last", "n", "bound")
    contenders = tables.durable(contenders)
    found, wanted, nothing = None, SETTLED * top_k, F.lit(None).cast("long")
    pending = tables.durable(contenders.select("lang").distinct().select("lang", nothing.alias("high"), nothing.alias("kth")))
    while not pending.isEmpty():
        left = contenders.join(pending, "lang").where("high IS NULL OR bound < high")
        place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("bound")))
        cut = left.select("lang", "bound", place.alias("place")).where(F.col("place") == wanted).select("lang", F.col("bound").alias("cut"))
        lows = tables.durable(pending.join(cut, "lang", "left").select("lang", "high", F.coalesce("kth", "cut", F.lit(0)).alias("low")))
        some = tables.durable(contenders.join(lows, "lang").where("bound >= low AND (high IS NULL OR bound < high)").select(*contenders.columns))
        got = _settled(sequences, some, least, tables)
        found = got if found is None else tables.durable(found.union(got))
        now = lows.join(_kth(found, top_k), "lang", "left")
        pending = tables.durable(now.where("low > 0 AND coalesce(kth, -1) < low").select("lang", F.col("low").alias("high"), "kth"))
        wanted *= 4
    return found


def _kth(found: DataFrame, top_k: int) -> DataFrame:
    """(lang, kth): the score in place ``top_k``, of languages that have so many."""
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score")))
    return found.select("lang", "score", place.alias("place")).where(F.col("place") == top_k).select("lang", F.col("score").alias("kth"))


def _at(names: list[str], i: Column) -> Column:
    return F.element_at(F.array(*names), i)


def _settled(sequences: DataFrame, contenders: DataFrame, least: int, tables: Workspace) -> DataFrame:
    """The contenders that lie in no longer phrase of the same count, with their exact scores: counts of all their parts are taken in one pass."""
    cut = contenders.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    rest = [F.when(F.col("k") + i <= F.col("m"), _at(_WORDS, F.least(F.col("k") + i, F.lit(LONGEST)))).otherwise(0).alias(f"s{i}") for i in range(1, LONGEST + 1)]
    cut = cut.select("*", *rest, _at(_COUNTS, F.col("k")).alias("l"))
    parts = cut.where("m - k > 1").select("lang", *[F.col(f"s{i}").alias(f"w{i}") for i in range(1, LONGEST + 1)])
    nodes = Nodes(tables.durable(contenders.select("lang", *_WORDS).union(parts).distinct()), _WORDS)
    seen = tables.durable(_context(sequences, nodes).where(F.col("a") >= least))
    nodes.forget()
    sides = seen.select("lang", *[F.col(f"w{i}").alias(f"s{i}") for i in range(1, LONGEST + 1)], F.col("a").alias("rest"))
    cut = cut.join(sides, ["lang", *[f"s{i}" for i in range(1, LONGEST + 1)]], "left").withColumn("r", F.when(F.col("m") - F.col("k") == 1, F.col("f_last")).otherwise(F.col("rest")))
    score = _ratio(F.col("n"), [F.col("a")], [F.col("l"), F.col("r")])
    best = cut.groupBy("lang", "m", *_WORDS, "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("worst"))
    best = best.join(seen.where("NOT inside").select("lang", *_WORDS), ["lang", *_WORDS], "left_semi")
    return tables.durable(best.select("lang", "m", *_WORDS, "a", "worst.l", "worst.r", "n", "worst.score"))


def mine(documents: DataFrame, top_k: int = 2000, least: int = 100) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top_k`` phrases by score descending, a descending, phrase ascending.

    A-Z are lower-cased; texts (null: empty) are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words ``[^\\x20\\x09]+``; a null lang is
    und. n counts all words of the language, a all occurrences of the phrase (2 to 5 words, at least ``least`` times), l and r those of its parts
    at the cut of the least score (ties: the shortest first part). Phrases that lie in a longer one (up to five words) with as many
    occurrences are dropped. Repeated rows count as often as they stand, texts of any length count whole, an empty table gives no
    rows, other columns don't matter. Should a frequent word share its 64-bit hash with another, another hash function is taken.
    """
    with Workspace(documents.sparkSession) as tables:
        for seed in range(8):
            counted = _count_words(documents, seed).groupBy("lang", "h").agg(F.sum("c").alias("f"), F.min("g").alias("low"), F.max("g").alias("high"))
            counted = tables.durable(counted.where((F.col("f") >= least) | (F.col("h") == 0)))
            if counted.where("low <> high").isEmpty():
                break
        else:
            raise RuntimeError("frequent words share their hashes whatever the hash function")
        words, totals = counted.where("h <> 0").select("lang", "h", "f"), counted.where("h = 0").select("lang", F.col("f").alias("n"))
        nodes = Nodes(words, ["h"])
        sequences = tables.durable(_encode(documents, nodes, seed))
        nodes.forget()
        spread = words.groupBy("lang").agg(F.floor(F.percentile("f", F.lit(FIRST_SHARE), F.col("f"))).cast("long").alias("top"), F.max("f").alias("most"))
        limits = tables.durable(totals.join(spread, "lang").select("lang", "n", "top", "most", F.lit(0).cast("long").alias("score")))
        settled: list[DataFrame] = []
        while not limits.isEmpty():
            found = _wave(sequences, words, limits.drop("most"), top_k, least, tables)
            if found is None:
                found = tables.durable(_nothing(documents))
            now = limits.join(_kth(found, top_k), "lang", "left")
            beyond = _ratio(F.col("n"), [], [F.col("top") + 1])  # no node left has a higher bound
            done = (F.col("top") >= F.col("most")) | (F.coalesce("kth", F.lit(-1)) > beyond)
            now = tables.durable(now.withColumn("done", done))
            final = found.join(now.where("done").select("lang", F.coalesce("kth", F.lit(0)).alias("kth")), "lang").where("score >= kth").drop("kth")
            settled.append(tables.durable(final))
            wider = F.least(F.col("most"), F.coalesce(_ratio(F.col("n"), [], [F.greatest("kth", F.lit(1))]), F.col("most")))
            limits = tables.durable(now.where("NOT done").select("lang", "n", wider.alias("top"), "most", F.coalesce("kth", F.lit(0)).cast("long").alias("score")))
        phrases = settled[0] if settled else _nothing(documents)
        for more in settled[1:]:
            phrases = phrases.union(more)
        each = phrases.select("*", F.posexplode(F.slice(F.array(*_WORDS), F.lit(1), F.col("m"))).alias("place", "h"))
        needed = tables.durable(each.select("lang", "h").distinct())
        nodes = Nodes(needed, ["h"])
        spelled = tables.durable(_spelled(documents, nodes, seed).join(needed, ["lang", "h"], "left_semi"))
        nodes.forget()
        whole = each.join(spelled, ["lang", "h"]).groupBy("lang", *_WORDS, "a", "l", "r", "n", "score").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("words"))
        whole = whole.withColumn("phrase", F.array_join("words.word", " "))
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = whole.select("lang", F.row_number().over(order).cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
        return tables.keep(tables.durable(ranked.where(F.col("rank") <= top_k)))


def _nothing(documents: DataFrame) -> DataFrame:
    return documents.sparkSession.createDataFrame([], ", ".join(["lang string", "m int", *[f"{c} long" for c in (*_WORDS, "a", "l", "r", "n", "score")]]))
