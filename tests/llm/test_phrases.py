"""Phrase mining against counting every phrase in plain Python."""

import collections
import random
import re

import numpy as np
import pytest

from gridlake.llm import phrases, queries
from tests.checks import assert_same, connection

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(rows, top_k, least):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    f[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang in f:
        known = {p: a for p, a in f[lang].items() if len(p) > 1 and a >= least}
        inside = set()
        for q, b in known.items():
            for m in range(2, len(q)):
                inside.update(q[i : i + m] for i in range(len(q) - m + 1) if 100 * b >= 100 * f[lang][q[i : i + m]])
        kept = []
        for p, a in known.items():
            score, k = min((1000 * a * n[lang] // (f[lang][p[:k]] * f[lang][p[k:]]), k) for k in range(1, len(p)))
            if p not in inside:
                kept.append((-score, -a, " ".join(p).encode(), f[lang][p[:k]], f[lang][p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:top_k], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def found(spark, rows, **how):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, phrase string, rank int")
    return sorted(tuple(r[c] for c in COLUMNS) for r in phrases.mine(frame, **how).collect())


def sample(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    fixed = ["Deep blue sea", "new york city hall", "é ü ö 漢字", "one two three four five six"]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(fixed))
        text = "".join(w + rng.choice([" ", " ", " ", "\t ", ", ", ".\n", "; ", " ? "]) for w in words)
        rows.append((text, ["en", "de", None, ""][i % 4]))
    return [*rows, (None, "en"), ("", "fr"), (" .,; \n", "fr"), ("a b " * 40, "xx"), ("a b " * 40, "xx"), rows[0], rows[0], (None, None)]


@pytest.mark.parametrize("top_k", [3, 2000])
def test_against_brute_force(spark, top_k):
    rows = sample(top_k)
    assert found(spark, rows, top_k=top_k, least=6) == brute(rows, top_k, 6)


def test_small_pieces_steps_and_few_bits_give_the_same(spark, monkeypatch):
    """Tasks get these constants with their functions' modules, so only what the driver reads is changed here: waves and bitmap sizes."""
    rows = sample(8)
    wanted = brute(rows, 20, 5)
    for name, value in (("FIRST_SHARE", 0.02), ("SETTLED", 1), ("LEAST_BITS", 15), ("MOST_BITS", 15)):
        monkeypatch.setattr(phrases, name, value)
    assert found(spark, rows, top_k=20, least=5) == wanted


def test_ties_at_the_last_rank_are_settled(spark):
    rows = [(f"u{i} v{i}. ", "en") for i in range(30) for _ in range(4)]
    assert found(spark, rows, top_k=7, least=4) == brute(rows, 7, 4)


def test_scores_of_over_64_bits(spark):
    from pyspark.sql import functions as F

    big = 10**15
    row = spark.createDataFrame([(big, big - 1, big - 7, 3)], "n long, a long, l long, r long").select(phrases._ratio(F.col("n"), [F.col("a")], [F.col("l"), F.col("r")]).alias("s")).first()
    assert row.s == 1000 * big * (big - 1) // ((big - 7) * 3)


def test_empty_tables_and_rare_words(spark):
    assert found(spark, [], top_k=5, least=2) == []
    assert found(spark, [("a b c", "en"), (None, None)], top_k=5, least=2) == []


def test_shared_hashes_are_noticed(spark, monkeypatch):
    rows = [("x y", "en")] * 3
    frame = spark.createDataFrame(rows, "text string, lang string")
    plain = phrases._count_words
    monkeypatch.setattr(phrases, "_count_words", lambda d, seed: plain(d, seed) if seed == 2 else plain(d, seed).selectExpr("lang", "if(h = 0, 0L, 1L) as h", "g", "c"))
    assert [r.phrase for r in phrases.mine(frame, 5, 2).collect()] == ["x y"]


def test_long_rows_are_cut_at_piece_ends():
    texts = [(" ".join(f"w{i % 7}" for i in range(5000)) + ". ").encode() * 3]
    _, _, _, h, piece = phrases.tokenize(texts)
    assert len(h) == 15_000 and np.bincount(piece - piece[0])[[0, 1, 2]].tolist() == [5000] * 3


def test_tally_merges():
    rng = np.random.default_rng(1)
    tally, wanted = phrases.Tally(), collections.Counter()
    for _ in range(5):
        k = rng.integers(0, 9, 200).astype(np.uint64)
        wanted.update(k.tolist())
        tally.add(k % np.uint64(4), [np.zeros(200, np.uint64), k], np.ones(200, np.int64))
    got = collections.Counter()
    for batch in tally.take(["lang", "k", "c"], ["en"]):
        for r in batch.to_pylist():
            got[r["k"]] += r["c"]
    assert got == wanted


def test_query_matches_sql_with_a_lower_bound(spark):
    sf = "/root/testdata/sf0.001"
    sql = queries.ORACLE_SQL["op12_phrases"].replace("f >= 100", "f >= 12")
    assert_same(phrases.mine(spark.read.parquet(f"{sf}/documents.parquet"), 2000, 12).toPandas(), connection(sf).sql(sql).df())
