"""Language identification by cross-parsing entropy.

For each language a suffix automaton of bounded labelled text recognises all its substrings. A text is parsed greedily
into the longest phrases that occur there; few phrases for a text's length mean that its entropy relative to the
language is low. The language with the fewest phrases per character wins. A text is parsed whole: it is cut into blocks that
are parsed at once, and each block's parse is then mended from the state in which the block before it ended.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridlake.llm.sampling import bounded_ids, texts_of
from gridlake.llm.text import chunks, mix

UNKNOWN = "und"
ALPHABET = 62
#: Class 0 stands for runs of characters that aren't letters, 1 to OWN for single letters, the next for shared ones, ALPHABET for unseen letters.
OWN = 40
_UNSEEN, _PAD = ALPHABET, ALPHABET + 1
BLOCK = 384
#: Blocks to mend from which on they are mended one by one.
FEW = 64
_cache: dict[int, tuple[np.ndarray, dict[str, np.ndarray]]] = {}


@cache
def letters() -> np.ndarray:
    """Boolean table of all code points: True for letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def automaton(classes: np.ndarray) -> np.ndarray:
    """Dense table of the suffix automaton of a class sequence: row state, column class, entry
    2 * next state, plus 1 where the phrase so far can't be extended and a new one begins with this class."""
    nexts: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in classes.tolist():
        current = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nexts[p]:
            nexts[p][c] = current
            p = link[p]
        if p != -1:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[current] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[current] = clone
        last = current
    root = np.ones(ALPHABET + 2, np.int32)  # unseen: back to the start, one phrase
    for c, to in nexts[0].items():
        root[c] = 2 * to + 1
    table = np.tile(root, (len(nexts), 1))
    states = np.repeat(np.arange(len(nexts)), [len(d) for d in nexts])
    columns = np.fromiter((c for d in nexts for c in d), np.int64)
    table[states, columns] = np.fromiter((2 * to for d in nexts for to in d.values()), np.int32)
    first = np.array(sorted(nexts[0]), int)
    table[0, first] = root[first]  # a phrase opens
    table[:, _PAD] = 2 * np.arange(len(nexts))
    return table


def class_table(training: dict[str, str]) -> np.ndarray:
    """Class of each code point: the OWN most frequent letters of the training texts get their own, its other letters share the rest
    by a hash (so scripts of thousands of letters still differ word by word), and letters it doesn't have are unseen."""
    found = np.concatenate([np.frombuffer(t.lower().encode("utf-32-le", "replace"), np.uint32) for t in training.values()] or [np.zeros(0, np.uint32)])
    is_letter = letters()
    count = np.bincount(found[is_letter[found]], minlength=len(is_letter))
    table = np.where(is_letter, _UNSEEN, 0).astype(np.int16)
    order = np.argsort(-count, kind="stable")
    order = order[: np.count_nonzero(count)]
    table[order[:OWN]] = np.arange(1, len(order[:OWN]) + 1)
    rest = order[OWN:]
    table[rest] = OWN + 1 + (mix(rest.astype(np.uint64)) % np.uint64(ALPHABET - OWN - 1)).astype(np.int16)
    return table


def classes_of(text: str, table: np.ndarray) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    found = table[points]
    return found[(found != 0) | np.concatenate([[0], found[:-1]]).astype(bool)]  # one class 0 for a run, none in front


def models(training: dict[str, str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The class table and each language's automaton, built once in a Python worker."""
    key = hash(tuple(sorted(training.items())))
    if key not in _cache:
        _cache.clear()
        table = class_table(training)
        _cache[key] = table, {lang: automaton(classes_of(text, table)) for lang, text in sorted(training.items())}
    return _cache[key]


def phrases(sequences: list[np.ndarray], automata: list[np.ndarray], size: int = BLOCK) -> np.ndarray:
    """Phrases of each sequence (row) against each automaton (column).

    Blocks of ``size`` classes are parsed in step, as if a phrase began with each. Then every block is parsed again from the state
    in which the one before ended, up to the first place where a phrase begins in both parses: from there on they are the
    same. A block that they never agree in hands its new end state on, until nothing changes. So the result is that of
    parsing each sequence from its front.
    """
    counts = np.array([-(-len(s) // size) for s in sequences])
    owner = np.repeat(np.arange(len(sequences)), counts)
    out = np.zeros((len(sequences), len(automata)), np.int64)
    if not len(owner):
        return out
    lens = np.array([len(s) for s in sequences])
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    length = np.minimum(lens[owner] - nth * size, size)
    order = np.argsort(-length, kind="stable")  # blocks that still run stay in front
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    flat = np.concatenate(sequences)
    begin = (np.repeat(np.cumsum(lens) - lens, counts) + nth * size)[order]
    length = length[order]
    before = np.where(nth > 0, place[np.arange(len(order)) - 1], -1)[order]  # the block in front, by place
    after = np.full(len(order), -1)
    after[before[before >= 0]] = np.flatnonzero(before >= 0)
    running = np.searchsorted(-length, -np.arange(1, size + 1), "right")
    columns = [flat[begin[:n] + i].astype(np.int32) for i, n in enumerate(running) if n]
    width = np.int32(ALPHABET + 2)
    for k, table in enumerate(automata):
        step = table.ravel()
        state = np.zeros(len(begin), np.int32)
        opens = np.zeros((len(columns), len(begin)), bool)
        for i, c in enumerate(columns):
            n = len(c)
            found = step[state[:n] * width + c]
            opens[i, :n] = found & 1
            state[:n] = found >> 1
        count = opens.sum(0)
        entered = np.zeros(len(begin), np.int32)  # state in which each block is entered, so far
        entries = memoryview(step)
        todo = np.flatnonzero(before >= 0)
        while len(todo):
            start = state[before[todo]]
            lanes, now = todo[start != entered[todo]], start[start != entered[todo]]
            entered[lanes] = now
            changed, i = [np.zeros(0, np.int64)], 0
            while len(lanes) > FEW:
                over = length[lanes] <= i  # the parses didn't meet in the block
                if over.any():
                    state[lanes[over]] = now[over]
                    changed.append(lanes[over])
                    lanes, now = lanes[~over], now[~over]
                    continue
                found = step[now * width + flat[begin[lanes] + i].astype(np.int32)]
                new = (found & 1).astype(bool)
                met = new & opens[i, lanes]
                count[lanes] += new.astype(np.int64) - opens[i, lanes]
                opens[i, lanes] = new
                lanes, now, i = lanes[~met], (found >> 1)[~met], i + 1
            for lane, at in zip(lanes.tolist(), now.tolist(), strict=True):  # the last few one by one, without numpy's price of a step
                stop, more, fresh = int(length[lane]), 0, []
                for c, own in zip(flat[begin[lane] + i : begin[lane] + stop].tolist(), opens[i:stop, lane].tolist(), strict=True):
                    found = entries[at * (ALPHABET + 2) + c]
                    at, new = found >> 1, found & 1
                    if new and own:
                        break
                    more += new - own
                    fresh.append(new)
                else:
                    state[lane] = at
                    changed.append(np.array([lane]))
                count[lane] += more
                opens[i : i + len(fresh), lane] = fresh
            todo = after[np.concatenate(changed)]
            todo = todo[todo >= 0]
        np.add.at(out[:, k], owner[order], count)
    return out


def identify(texts: list[str], training: dict[str, str]) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text; ties go to the first language by name. Without training texts or letters: und, 0."""
    table, automata = models(training)
    sequences = [classes_of(t, table) for t in texts]
    has_letter = np.array([bool((s != 0).any()) for s in sequences], bool)
    if not automata:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    names = list(automata)
    rate = phrases(sequences, [automata[n] for n in names]) / np.maximum([[len(s)] for s in sequences], 1)
    best = rate.argmin(1)
    share = np.exp(-12 * (rate - rate.min(1, keepdims=True)) / np.maximum(rate.min(1, keepdims=True), 1e-9))
    score = 1 / share.sum(1)
    return [names[b] if ok else UNKNOWN for b, ok in zip(best, has_letter, strict=True)], np.where(has_letter, score, 0.0)


def train(documents: DataFrame, per_language: int = 120, max_chars: int = 24_000, total_chars: int = 1_000_000) -> dict[str, str]:
    """Text of each non-null language: heads of at most ``max_chars`` characters of at most ``per_language`` labelled documents,
    cut at ``max_chars`` a language and, where there are many languages, at an equal share of ``total_chars``.

    These documented bounds fix what a Python worker holds: a state or two of 256 bytes a character, so 0.5 GB at most. Languages
    without a letter in their sample are left out; so are rows without doc_id or lang.
    """
    ids = bounded_ids(documents, "doc_id", "lang", per_language)
    lang_of = {i: str(lang) for lang, found in ids.items() for i in found}
    bound = min(max_chars, total_chars // max(1, len(ids)))
    out: dict[str, list[str]] = {}
    for i, text in texts_of(documents.where("lang IS NOT NULL"), list(lang_of), max_chars=bound).items():
        if text and any(c.isalpha() for c in text):
            out.setdefault(lang_of[i], []).append(text)
    return {lang: " ".join(texts)[:bound] for lang, texts in out.items()}


def predict(documents: DataFrame, training: dict[str, str]) -> DataFrame:
    """All columns of documents plus ``lang_pred`` and ``score`` (own columns of those names are replaced).

    Null texts and texts without a letter get und and 0. One pass of mapInArrow; what is broadcast is the training
    text (bounded), from which each Python worker builds its automata once.
    """
    keep = [c for c in documents.columns if c not in ("lang_pred", "score")]
    sent = documents.sparkSession.sparkContext.broadcast(training)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs: list[str] = []
            scores = [np.zeros(0)]
            for _, texts in chunks(batch.column("text")):
                found, s = identify([t.decode("utf-8", "replace") for t in texts], sent.value)
                langs += found
                scores.append(s)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(np.concatenate(scores))], names=[*keep, "lang_pred", "score"])

    schema = documents.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return documents.select(*keep).mapInArrow(run, schema)


def held_out(of: int = 3, remainder: int = 1) -> F.Column:
    """True for the fold kept from training; a null doc_id is in no fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == remainder, F.lit(False))
