"""The training-data operators against brute force, and on awkward tables."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.llm import decontaminate, fingerprint, html_extract, langid, minhash_dedup, ngram_join, packing, quality, queries, sharding, text, toxicity, warc
from tests.checks import assert_same, connection

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, score double, predicted int, items string, keys string"


@pytest.fixture(scope="module")
def awkward(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "en", "s"), (2, "alpha beta gamma delta epsilon zeta", "en", "s"), (2, "alpha beta gamma delta epsilon zeta", "en", "s"),
        (3, None, None, None), (4, "", "fr", "t"), (5, " \n\t ", None, "s"), (6, "one", "en", None), (None, "alpha beta gamma delta epsilon zeta", None, "s"), (None, None, None, None),
        (7, long, "en", "s"), (8, long + " end", "en", "s"), (9, "x" * 200_000, "de", "s"), (10, "ÄÖ ü 漢字 🙂", "de", "s"), (-5, "one", "en", "s"), (11, "12 34 ... !!", "en", "s"),
    ]
    return spark.createDataFrame([(*r, 0.5, 7, "i", "k") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def ids(frame):
    return collections.Counter(r.doc_id for r in frame.select("doc_id").collect())


# --- helpers --------------------------------------------------------------------------------------------------------


def test_words_and_shingles_match_regular_expressions():
    import re

    texts = ["The quick\tbrown fox", "", "a", "Ünï cødé words HERE 12-34", "x" * 50 + "  y"]
    row, value = text.words([t.encode() for t in texts], text.WHITE)
    found = collections.defaultdict(list)
    for r, v in zip(row.tolist(), value.tolist()):
        found[r].append(v)
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    plain = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for t in texts]
    assert [len(found[i]) for i in range(len(texts))] == [len(p) for p in plain]
    assert len({v for f in found.values() for v in f}) == len({w for p in plain for w in p})
    row, _ = text.shingle_sets([b"a b c d e", b"a b", b"", b"a b a b a b a b"], 4)
    assert np.bincount(row, minlength=4).tolist() == [2, 1, 0, 2]


# --- 1, 5, 6: classifiers -------------------------------------------------------------------------------------------


def test_toxicity_learns_and_reads_misspellings():
    rng = random.Random(3)
    clean = "river stone walking forest quiet table window garden simple yellow paper morning".split()
    bad = "vileword nastyterm".split()
    say = lambda n: [rng.choice(clean) for _ in range(n)]
    texts, labels = [], []
    for i in range(240):
        words = say(rng.randint(5, 60))
        if i % 3 == 0:
            words[rng.randrange(len(words))] = rng.choice(bad)
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    model = toxicity.fit(texts[:160], labels[:160])
    scores = toxicity.score_texts(model, [t.encode() for t in texts[160:]])
    assert ((scores >= 0.3) == np.array(labels[160:], bool)).mean() > 0.95
    odd, plain = toxicity.score_texts(model, [b"quiet vilewwords garden", b"quiet window garden"])
    assert odd > 0.3 > plain


def test_toxicity_does_not_depend_on_where_a_long_text_is_cut(monkeypatch):
    rng = random.Random(5)
    clean = [f"word{i}" for i in range(60)]
    texts = [" ".join(rng.choice(clean) for _ in range(30)) + (" nastyterm here" if i % 2 else "") for i in range(120)]
    model = toxicity.fit(texts, [i % 2 for i in range(120)])
    long = [" ".join(rng.choice(clean) for _ in range(900)).encode(), b"", " ".join([*clean * 6, "nastyterm", *clean * 6]).encode(), b"x" * 5000]
    whole = toxicity.score_texts(model, long)
    monkeypatch.setattr(text.pieces, "__defaults__", (128,))
    assert np.allclose(toxicity.score_texts(model, long), whole) and whole[2] > 0.3 > whole[0]


def test_toxicity_score_against_a_plain_mean():
    """Every run of two words, the mean of its n-grams' weights, the largest of them, and the calibration, without any batching."""
    rng = random.Random(8)
    clean = [f"word{i}" for i in range(60)]
    texts = [" ".join(rng.choice(clean) for _ in range(rng.randint(1, 40))) + (" nastyterm, here" if i % 2 else "") for i in range(80)]
    model = toxicity.fit(texts, [i % 2 for i in range(80)])
    for t in (*texts[:20], "one", "ONE Two", "Ünï cødé -- 12 nastyterms!", "", " \n"):
        words = t.encode().split()
        best, runs = None, [words[i : i + 2] for i in range(max(len(words) - 1, 1))] if words else []
        for run in runs:
            grams = [toxicity.subwords([w])[0] for w in run]
            total, n = sum(float(model.weight[g].astype(float).sum()) for g in grams), sum(map(len, grams))
            logit = total / max(n, 1) + model.bias
            best = logit if best is None or logit > best else best
        z = model.slope * (model.bias - 8.0 if best is None else best) + model.shift + model.drift * np.log(max(len(runs), 1))
        assert abs(toxicity.score_texts(model, [t.encode()])[0] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-6


def test_toxicity_does_not_drift_with_length():
    """Held out: clean texts of any length stay, joined ones too, toxic ones of the usual lengths are found."""
    import pyarrow.parquet as pq

    table = lambda name, columns: pq.read_table(f"/root/testdata/sf0.1/{name}.parquet", columns=columns).to_pandas()
    texts = table("documents", ["doc_id", "text"]).set_index("doc_id").text
    labels = table("labels", ["doc_id", "toxic"])
    held = labels.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)
    train = {y: [texts[i] for i in labels[~held & (labels.toxic == y)].doc_id if len(texts[i]) <= 8000][:1200] for y in (0, 1)}
    model = toxicity.fit(train[0] + train[1], [0] * len(train[0]) + [1] * len(train[1]))
    flagged = lambda found: toxicity.score_texts(model, [t.encode() for t in found]) >= 0.3
    clean, toxic = ([texts[i] for i in labels[held & (labels.toxic == y)].doc_id] for y in (0, 1))
    sizes, marks = np.array([len(t) for t in clean]), flagged(clean)
    for low, high in ((0, 1000), (1000, 3000), (3000, 8000), (8000, 1 << 40)):
        assert marks[(sizes >= low) & (sizes < high)].mean() < 0.03, (low, high)
    assert flagged(toxic).mean() > 0.92
    rng = random.Random(4)
    for k in (5, 20, 80):
        assert flagged([" ".join(rng.sample(clean, k)) for _ in range(100)]).mean() < 0.08, k


def test_quality_learns_words_alone():
    rng = random.Random(1)
    texts, labels = [], []
    for i in range(600):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randint(20, 60))]
        for _ in range(2):
            words[rng.randrange(len(words))] = f"{'good' if i % 2 else 'bad'}{rng.randrange(5)}"
        texts.append(" ".join(words))
        labels.append(i % 2)
    model = quality.fit(texts[:400], labels[:400])
    assert ((quality.score_texts(model, [t.encode() for t in texts[400:]]) >= 0.5) == np.array(labels[400:], bool)).mean() > 0.95


def test_quality_vote_against_brute_force(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["aa", "bb", "Cc", "d1", "e!"]) for _ in range(rng.randint(1, 30))) for _ in range(90)]
    labels = [rng.randrange(2) for _ in range(60)]
    model = quality.fit(texts[:60], labels, neighbours=7)
    vectors = [quality.project(model, [t.encode()])[0] for t in texts]
    for t, v, score in zip(texts[60:], vectors[60:], quality.score_texts(model, [t.encode() for t in texts[60:]], block=4), strict=True):
        near = sorted(((float(v @ o), y) for o, y in zip(vectors[:60], labels, strict=True)), reverse=True)[:7]
        assert abs(score - sum(max(c, 1e-3) * y for c, y in near) / sum(max(c, 1e-3) for c, _ in near)) < 1e-4
    whole = quality.terms([t.encode() for t in texts])
    monkeypatch.setattr(quality, "_BLOCK", 16)
    assert np.allclose(quality.terms([t.encode() for t in texts]), whole)


def test_classifiers_on_awkward_tables(spark, awkward):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (7, 1, 1), (99, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality):
        model = module.train(awkward, labels)
        out = module.score(awkward, model)
        assert ids(out) == ids(awkward) and set(out.columns) == set(awkward.columns)
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.collect())
        assert module.score(awkward.where("false"), module.train(awkward.where("false"), labels)).count() == 0
    out = langid.predict(awkward, langid.train(awkward)).collect()
    assert len(out) == 15 and {r.lang_pred for r in out if r.doc_id in (3, 4, 5, 11)} == {"und"}
    assert langid.identify(["🙂 🙂 12", "漢字"], {"en": "the quick brown fox"})[0] == ["und", "en"]
    assert {r.lang_pred for r in langid.predict(awkward, {}).collect()} == {"und"}


def test_held_out_folds(spark, docs):
    for r in docs.select("doc_id", toxicity.held_out(4, 2).alias("a"), langid.held_out().alias("b")).collect():
        n = zlib.crc32(str(r.doc_id).encode())
        assert (r.a, r.b) == (n % 4 == 2, n % 3 == 1)


def test_automaton_counts_phrases():
    def naive(seq, ref):
        n = at = 0
        while at < len(seq):
            size = 1
            while at + size < len(seq) and bytes(seq[at : at + size + 1]) in bytes(ref):
                size += 1
            at, n = at + size, n + 1
        return n

    rng = np.random.default_rng(1)
    ref = rng.integers(1, 4, 400).astype(np.int64)
    table = langid.automaton(ref)
    for n in (0, 1, 5, 300, 3000):
        seq = rng.integers(1, 5, n).astype(np.int64)
        for size in (1, 2, 7, 64, 384):  # blocks don't show in the result
            assert langid.phrases([seq, seq[:0], seq[::-1]], [table], size)[:2].tolist() == [[naive(seq.astype(np.uint8), ref.astype(np.uint8))], [0]]


def test_languages_of_many_scripts_and_of_long_documents_only(spark):
    rng = random.Random(8)
    alphabets = {"h1": (0x4E00, 300), "h2": (0x5500, 300), "k": (0xAC00, 200), "c1": (0x430, 32), "c2": (0x430, 32), "l1": (0x61, 26), "l2": (0x61, 26)}
    vocabulary = {lang: ["".join(chr(a + rng.randrange(n)) for _ in range(rng.randint(1, 6))) for _ in range(150)] for lang, (a, n) in alphabets.items()}
    say = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    rows = [(i, say(lang, 8000 if lang == "l2" else 60), lang) for i, lang in enumerate(list(alphabets) * 20)]
    training = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(training) == set(alphabets) and max(map(len, training.values())) <= 24_000
    tests = [(say(lang, 25), lang) for lang in alphabets for _ in range(20)]
    found, _ = langid.identify([t for t, _ in tests], training)
    assert np.mean([f == lang for f, (_, lang) in zip(found, tests, strict=True)]) > 0.97
    few = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), total_chars=7000)
    assert max(map(len, few.values())) <= 1000


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, sf):
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = queries.op5_language(spark, sf).join(documents, "doc_id").where("held_out")
    assert found.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    found = queries.op6_quality(spark, sf).join(labels, "doc_id").where("held_out")
    assert found.select(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.95


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    found = queries.op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    by = {(r.toxic, r.predicted): r["count"] for r in found.groupBy("toxic", "predicted").count().collect()}
    assert by[1, 1] / (by[1, 1] + by[1, 0]) > 0.92 and by[1, 1] / (by[1, 1] + by.get((0, 1), 0)) > 0.85


# --- 2: sharding ----------------------------------------------------------------------------------------------------


def test_jump_hash_moves_only_into_the_new_shard():
    keys = np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 20_000)
    before, after = sharding.jump(keys, 40), sharding.jump(keys, 41)
    assert set(after[before != after]) == {40} and abs((before != after).mean() - 1 / 41) < 0.005
    assert np.bincount(before, minlength=40).min() > 400 and (sharding.jump(keys, 1) == 0).all()

    def plain(key, n):
        b, j = -1, 0
        key &= (1 << 64) - 1
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
            j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
        return b

    assert [plain(int(k), 40) for k in keys[:500]] == before[:500].tolist()


def test_sharding_slots_and_digests(spark, awkward):
    rows = sharding.assign(awkward, 3).collect()
    assert len(rows) == 15
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    by = {r.doc_id: r for r in rows}
    assert (by[3].size, by[3].text_crc32, by[6].size, by[6].text_crc32) == (16, 0, 19, zlib.crc32(b"one"))
    assert all(r.grown_shard in (r.shard, 3) for r in rows) and sharding.assign(awkward.where("false")).count() == 0


# --- 3: packing -----------------------------------------------------------------------------------------------------


def test_best_fit_takes_the_tightest_compatible_bin():
    assert packing.best_fit([6, 5, 4, 4], ["a", "b", "a", "c"], [None] * 4, 10) == [0, 1, 1, 0]
    assert packing.best_fit([5, 5, 5], ["a", "b", "c"], [1, 1, 2], 10) == [0, 1, 0]
    assert packing.best_fit([0, 0, 10], [None] * 3, [None] * 3, 10) == [1, 1, 0] and packing.best_fit([], [], [], 10) == []


def test_packing_against_plain_best_fit():
    rng = random.Random(5)
    for _ in range(20):
        n = rng.randint(1, 60)
        sizes, sources, clusters = [rng.randint(0, 20) for _ in range(n)], [rng.choice("abcd") for _ in range(n)], [rng.randrange(12) for _ in range(n)]
        bins, out = [], [0] * n
        for i in sorted(range(n), key=lambda i: (-sizes[i], i)):
            fit = [(room, b) for b, (room, so, cl) in enumerate(bins) if room > 0 and room >= sizes[i] and sources[i] not in so and clusters[i] not in cl]
            if fit:
                _, b = min(fit)
                bins[b][0] -= sizes[i]
            else:
                b = len(bins)
                bins.append([20 - sizes[i], set(), set()])
            bins[b][1].add(sources[i])
            bins[b][2].add(clusters[i])
            out[i] = b
        assert packing.best_fit(sizes, sources, clusters, 20) == out


def test_packed_rows_are_whole(spark, awkward):
    rows = packing.pack(awkward, capacity=4).collect()
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.bin].append(r)
    for held in bins.values():
        assert sum(r.n_words for r in held) == held[0].fill <= 4
        for column in ("source", "cluster"):
            named = [r[column] for r in held if r[column] is not None]
            assert len(named) == len(set(named))
    assert sum(r.n_words for r in rows if r.doc_id == 7) == 30_000 and sum(r.doc_id == 3 for r in rows) == 1
    assert packing.pack(awkward.where("false")).count() == 0


# --- 4: fingerprints ------------------------------------------------------------------------------------------------


def test_fingerprints(spark, awkward):
    import hashlib

    rows = fingerprint.fingerprint_with_edits(awkward).collect()
    assert len(rows) == 15
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == by[2].fingerprint and by[3].fingerprint == by[4].fingerprint == by[5].fingerprint == ""
    assert by[8].near_next > 0.95 and by[9].n_chars == 200_000 and by[-5].near_next < 1
    text9 = "x" * (200_000 - 66_666) + (" ".join(f"w{i % 977}x{i}" for i in range(30_000)) + " end")[:66_666]
    assert by[9].edited_sha256 == hashlib.sha256(text9.encode()).hexdigest()
    assert by[10].edited_sha256 == hashlib.sha256(("ÄÖ ü 漢字 🙂"[:6] + "xxx").encode()).hexdigest()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert fingerprint.fingerprint_with_edits(awkward.where("false")).count() == 0


def plain_sketch(content, k=3):
    """The sketch in plain Python: occurrence-numbered k-mers, two smallest a slot in the order of the text."""
    import re
    import struct

    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fold = lambda values, seed=42: __import__("functools").reduce(lambda h, v: xxhash.xxh64(v, seed=h).intdigest(), values, seed)
    long, top = lambda x: struct.pack("<q", signed(x & ((1 << 64) - 1))), ((1 << 64) - 1) ^ ((1 << 24) - 1)
    words = [fold([w.encode()]) for w in re.findall(r"\S{1,12}", content or "", re.A)]
    if not words:
        return []
    kmers = [fold([long(w) for w in words[i : i + k]]) & top for i in range(len(words) - k + 1)] if len(words) >= k else [fold([long(w) for w in words]) & top]
    seen, numbered = collections.Counter(), []
    for at, g in enumerate(kmers):
        numbered.append((signed(fold([long(g), struct.pack("<i", seen[g])]) & top), at))
        seen[g] += 1
    slots = collections.defaultdict(list)
    for x, at in sorted(numbered):
        slots[(x % (1 << 64)) >> 58].append((at, x))
    out = []
    for slot, found in slots.items():
        joined = fold([long(x) for _, x in sorted(found[:2])])
        out.append((joined & (0x7FFFFFFF - 63)) | slot)
    return sorted(out, key=lambda s: s & 63)


def test_fingerprints_against_plain_python(spark, docs):
    rng = random.Random(6)
    texts = [r.text for r in docs.limit(40).collect()] + ["", None, "one", "a b", "a a a a a a a b a a a a", " ".join(rng.choice("xyz") for _ in range(300))]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", fingerprint.sketch("text").alias("s")).collect()
    for r in found:
        assert sorted(r.s, key=lambda s: s & 63) == plain_sketch(texts[r.i]), texts[r.i]
    rows = {r.doc_id: r for r in fingerprint.fingerprint_with_edits(docs).collect()}
    by = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(by, reverse=True)
    like = lambda a, b: len(set(a) & set(b)) / len({x & 63 for x in a} | {x & 63 for x in b}) if a or b else 1.0
    for i, following in list(zip(order, order[1:] + order[:1], strict=True))[::17]:
        t, other = by[i], by[following]
        n = len(t) // 3
        edited = t[: len(t) - n] + other[:n]
        a, b, c = plain_sketch(t), plain_sketch(edited), plain_sketch(other)
        assert rows[i].fingerprint == "".join(f"{x:08x}" for x in sorted(a, key=lambda s: rows[i].fingerprint.find(f"{s:08x}")))
        assert abs(rows[i].near_edited - like(a, b)) < 1e-9 and abs(rows[i].near_next - like(a, c)) < 1e-9


def test_fingerprint_feels_order(spark):
    words = [f"w{i}" for i in range(400)]
    turned = words[200:] + words[:200]
    half = [w if i % 2 else f"z{i}" for i, w in enumerate(words)]
    frame = spark.createDataFrame([(" ".join(words), " ".join(turned), " ".join(half), " ".join(words[:390] + ["q"] * 10))], "a string, b string, c string, d string")
    s = frame.select(*[fingerprint.sketch(c).alias(c) for c in "abcd"])
    same, moved, mixed, edited = s.select(*[fingerprint.likeness("a", c) for c in "abcd"]).first()
    assert same == 1.0 and mixed < moved < edited and edited > 0.85 and moved < 0.9


def test_next_lower_against_sorting(spark):
    values = [5, -7, 1 << 40, (1 << 40) + 1, 4095, 4096, 0, -(1 << 62), 12_345_678, *np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 500).tolist()]
    plan = fingerprint.next_lower(spark.range(50))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan
    found = {r.id: r.next_id for r in fingerprint.next_lower(spark.createDataFrame([(v,) for v in values], "id long")).collect()}
    order = sorted(values, reverse=True)
    assert found == dict(zip(order, order[1:] + order[:1]))


# --- 7: n-gram join -------------------------------------------------------------------------------------------------


def brute_components(rows, k, percent):
    import re

    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                label[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    least = {g: min((v for v in m if v is not None), default=None) for g, m in groups.items()}
    return sorted(((rows[i][0], len(sets[i]), least[root(i)]) for i in range(len(rows))), key=str)


def test_ngram_join_against_brute_force(spark):
    rng = random.Random(9)
    base = [f"v{rng.randrange(300)}" for _ in range(200)]
    rows = []
    for i in range(120):
        words = list(base) if i % 2 else [f"v{rng.randrange(300)}" for _ in range(rng.randrange(1, 80))]
        for _ in range(rng.randrange(12)):
            words[rng.randrange(len(words))] = "edit"
        rows.append((i * 3 - 50, " ".join(words)))
    rows += [(1000, rows[3][1]), (1001, None), (1002, ""), (None, rows[5][1]), (1003, "one two"), (1004, "ONE two")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for k, percent in ((4, 85), (5, 80)):
        found = sorted((tuple(r) for r in ngram_join.components(frame, k, percent).collect()), key=str)
        assert found == brute_components(rows, k, percent)


def test_ngram_join_parts_and_exact_search_give_the_same(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"v{i}" for i in range(100)]
    rows = []
    for i in range(90):
        words = list(base) if i < 60 else [f"v{(i % 3) * 40 + j % 90}" for j in range(70)]
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(5)}"
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = sorted(brute_components(rows, 4, 85))
    assert sorted(tuple(r) for r in ngram_join.components(frame, exact=True).collect()) == wanted
    for name, small in (("TASK_SHINGLES", 300), ("LIST_BLOCK", 7), ("HOT_KEYS", 20), ("CELLS", 64), ("LEAST_HOT", 10)):
        monkeypatch.setattr(ngram_join, name, small)
    assert sorted(tuple(r) for r in ngram_join.components(frame).collect()) == wanted


def test_ngram_join_finds_what_hubs_miss(spark):
    """Chains of texts that each link only with the next one: no text is a hub of them all."""
    rows = [(i, " ".join(f"w{j}" for j in range(i * 5, i * 5 + 80))) for i in range(0, 40)]
    rows += [(100 + i, " ".join(f"u{j}" for j in range(i * 30, i * 30 + 60))) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram_join.components(frame).collect()) == sorted(brute_components(rows, 4, 85))


def near_copies(seed, n, edits, base_words=150):
    """Copies of a few texts with random edits, and texts of their own."""
    rng = random.Random(seed)
    bases = [[f"b{b}w{rng.randrange(400)}" for _ in range(base_words)] for b in range(3)]
    rows = []
    for i in range(n):
        words = list(bases[i % 3]) if i % 4 else [f"v{rng.randrange(300)}" for _ in range(rng.randrange(1, 80))]
        for _ in range(rng.randrange(edits)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(9)}"
        rows.append((i * 3 - 50, " ".join(words)))
    return rows


def test_minhash_dedup_against_brute_force(spark):
    rows = near_copies(21, 160, 8)
    rows += [(1000, rows[3][1]), (1000, rows[3][1]), (1001, None), (1002, ""), (None, rows[5][1]), (1003, "one two"), (1004, "ONE two"), (None, "solitary words that nobody else has at all"), (None, None)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, v string, keys int")
    found = minhash_dedup.deduplicate(frame, 5, 85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute_components(rows, 5, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert minhash_dedup.deduplicate(frame.where("false")).count() == 0


def test_minhash_dedup_finds_what_hubs_miss(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i * 5, i * 5 + 90))) for i in range(0, 40)]
    rows += [(100 + i, " ".join(f"u{j}" for j in range(i * 30, i * 30 + 60))) for i in range(20)]
    found = minhash_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), 5, 85)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == sorted(brute_components(rows, 5, 85))


def test_posterior_bound_against_integration():
    """The chance that the least count of matches comes with the threshold or more, by summing the posterior density."""
    s = (np.arange(400_000) + 0.5) / 400_000
    for n, least in minhash_dedup.least_matches(85, 1e-6):
        chance = []
        for m in (least - 1, least):
            density = s**m * (1 - s) ** (n - m)
            chance.append(density[s >= 0.85].sum() / density.sum())
        assert chance[0] < 1e-6 <= chance[1]


def test_batches_keep_links_and_drop_others():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    a, b, link = [], [], []
    for i in range(300):
        one = rng.choice(pool, 400, replace=False)
        shared = 380 if i % 2 else 250
        other = np.concatenate([one[:shared], rng.integers(0, 1 << 63, 400 - shared, dtype=np.uint64)])
        for side, tokens in ((a, one), (b, other)):
            side.append(minhash_dedup.signature(np.sort(tokens), np.array([0]))[0])
        link.append(i % 2 == 1)
    left = set(minhash_dedup.unpruned(np.array(a), np.array(b), 85).tolist())
    assert left >= {i for i, x in enumerate(link) if x} and len(left) < 160


def test_minhash_dedup_awkward(spark, awkward):
    found = minhash_dedup.deduplicate(awkward)
    assert ids(found) == ids(awkward)
    by = collections.defaultdict(set)
    for r in found.collect():
        by[r.doc_id].add((r.component_id, r.kept))
    assert by[2] == {(1, False)} and by[3] == {(3, True)} and by[8] == {(7, False)} and by[6] == {(-5, False)} and by[None] == {(1, False), (None, True)}


def test_search_against_counting():
    rng = random.Random(2)
    sets = [np.array(sorted(rng.sample(range(60), rng.randrange(20, 40)))) for _ in range(50)] + [np.arange(30), np.arange(29), np.arange(31)]
    for percent in (50, 85):
        for s in sets:
            found = ngram_join.search(s, sets, percent)
            mine = set(s.tolist())
            assert found == [d for d, o in enumerate(sets) if 100 * len(mine & set(o.tolist())) >= percent * len(mine | set(o.tolist()))]
    assert ngram_join.search(sets[0], [], 85) == []


def test_long_texts_are_read_in_parts(monkeypatch):
    some = [(" ".join(f"w{i}" for i in range(3000))).encode(), b"", b"x" * 20_000 + b" y", "ü é".encode() * 900]
    whole = text.words(some, text.WHITE)
    monkeypatch.setattr(text.pieces, "__defaults__", (512,))
    assert all((a == b).all() for a, b in zip(whole, text.words(some, text.WHITE), strict=True))


def test_ngram_join_awkward(spark, awkward):
    found = ngram_join.components(awkward)
    assert ids(found) == ids(awkward)
    by = {r.doc_id: r for r in found.collect() if r.doc_id is not None}
    assert by[2].component_id == 1 and by[8].component_id == 7 and by[6].component_id == -5 and by[3].component_id == 3
    kept = ids(ngram_join.keep_one(awkward))
    assert kept == collections.Counter([1, 3, 4, 5, -5, 7, 9, 10, 11, None, None])
    assert ngram_join.components(awkward.where("false")).count() == 0


def test_keep_one_decides_by_row(spark):
    one, two, three, four = (" ".join(f"{name}{i}" for i in range(40)) for name in "abcd")
    near = three + " end"
    rows = [
        (1, one), (5, one), (5, two), (5, two), (5, None), (5, ""), (6, three), (6, four),  # 5: a copy of 1, its own text twice, empty; 6: two texts
        *[(None, t) for t in [near] * 20 + [three] * 20 + ["e f g h i j"] * 20], (None, None), (None, " "),
    ]
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n int").repartition(3)
    kept = ngram_join.keep_one(frame)
    assert kept.columns == frame.columns
    found = collections.Counter((r.doc_id, r.text) if r.text and r.text.strip() else (r.doc_id, "") for r in kept.collect())
    assert sum(found.pop((None, t), 0) for t in (near, three)) == 1
    assert found == collections.Counter([(1, one), (5, two), (5, ""), (6, three), (6, four), (None, "e f g h i j"), (None, ""), (None, "")])


# --- 8: decontamination ---------------------------------------------------------------------------------------------


def test_decontamination_awkward(spark, awkward, monkeypatch):
    bench = spark.createDataFrame([(1, "gamma delta epsilon", 1), (2, "one", 1), (3, None, 1), (4, "", 1), (None, "alpha", 1), (5, "ü 漢字 🙂", 1)], "item_id long, text string, extra int")
    for blocks in (400_000, 1):
        monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", blocks)
        out = decontaminate.annotate(awkward, bench)
        assert ids(out) == ids(awkward)
        by = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
        assert (by[1].n_words, by[1].n_hit, by[1].items, by[1].contaminated) == (6, 3, ["1"], True)
        assert (by[6].n_hit, by[10].n_hit, by[10].items, by[3].n_words, by[3].contaminated) == (1, 3, ["5"], 0, False)
    assert decontaminate.annotate(awkward, bench.where("false")).where("contaminated").count() == 0
    assert decontaminate.annotate(awkward.where("false"), bench).count() == 0


def test_decontamination_keeps_columns_of_any_name_and_cuts_long_items(spark, monkeypatch):
    rows = [(1, "mine", "a b c d e f g h i j k l m n o p", ["x"], [1])]
    frame = spark.createDataFrame(rows, "doc_id long, _n string, text string, _items array<string>, _spans array<int>")
    bench = spark.createDataFrame([(7, "z a b c d e f g h i j k l m n o q"), (8, "y " * 50)], "item_id long, text string")
    for block, scans in ((400_000, 4), (3, 2)):
        monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
        monkeypatch.setattr(decontaminate, "SCAN_BLOCKS", scans)
        (r,) = decontaminate.annotate(frame, bench).collect()
        assert (r["_n"], r["_items"], r["_spans"]) == ("mine", ["x"], [1]) and (r.n_words, r.n_hit, r.items, r.spans) == (16, 15, ["7"], [0, 15])


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_sql(spark, name):
    assert_same(queries.queries()[name](spark, SF).toPandas(), connection(SF).sql(queries.ORACLE_SQL[name]).df())


# --- 9: HTML --------------------------------------------------------------------------------------------------------


def test_html_regions():
    page = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header><h1>Site</h1></header><nav>Home | About</nav>
    <div class="cookie-notice">We use cookies</div><main><article><h1>Head &amp; line</h1><p>First   para<br>graph with <b>bo</b>ld.<p>Second.</p><form>Sign <input></form>
    <p>Third one is here and it is long enough to count as text.</p></article><section class="comments"><p>Great post, I liked it very much indeed!</p></section></main>
    <aside>Ads</aside><footer>&copy; me</footer></body></html>"""
    assert html_extract.main_text(page) == "Head & line First para graph with bold. Second. Third one is here and it is long enough to count as text."
    divs = "<body><div id=menu>a b c</div><div><div class=text><p>A long paragraph of the only text on this page, really.</p><p>Short.</p></div></div><div class='sidebar'>x</div></body>"
    assert html_extract.main_text(divs) == "A long paragraph of the only text on this page, really. Short."
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p></p>") == ""
    assert html_extract.main_text("plain words") == "plain words"
    assert html_extract.main_text("<body><div class='content with-sidebar'><p>Text of it.</p></div></body>") == "Text of it."
    assert html_extract.main_text("<body><div id=search><p>All that there is.</p></div></body>") == "All that there is."


def test_html_keeps_whole_articles():
    long = "A long paragraph that is most of the text on this page, really."
    assert html_extract.main_text(f"<html><head><title>T</title><body><p>{long}</p></body></html>") == long
    assert html_extract.main_text(f"<head><title>T</title>{long}") == long
    assert html_extract.main_text(f"<body><p>Top.</p><form action=x><div><p>{long}</p></div></form></body>") == f"Top. {long}"
    for name in ("sidebar-right", "x-widget-content"):
        assert long in html_extract.main_text(f"<body><p>Left over.</p><div class='{name}'><div><p>{long}</p></div></div></body>")
    for tag in ("nav", "form", "header"):
        assert long in html_extract.main_text(f"<body><div><{tag}><b>Top</b><p>Other.</p><p>{long}</p></div><p>{long} {long} {long}</p></body>")
    two = f"<article><p>{long} {long}</p></article><article><p>The second one is shorter but text too.</p></article>"
    assert html_extract.main_text(f"<body><main>{two}</main><nav>a</nav></body>") == f"{long} {long} The second one is shorter but text too."
    assert html_extract.main_text(f"<body>{two}</body>").endswith("text too.")
    menu = "".join(f"<li><a href=/{i}>Entry number {i} of it</a>" for i in range(30))
    assert html_extract.main_text(f"<body><nav><ul>{menu}</ul></nav><p>{long}</p></body>") == long


def test_html_sections_of_an_article():
    long = "A long paragraph that is most of the text on this page, really"
    page = f"""<html><body><nav>Menu</nav><article><header><h1>The headline</h1></header><p>{long} 1.</p><section id="discussion"><h2>Discussion</h2><p>{long} 2.</p></section>
    <div class="related-work"><p>{long} 3.</p></div><p class="side-effects">{long} 4.</p><div class="related"><ul><li><a href=1>Other story</a><li><a href=2>More</a></ul></div>
    <div class="notice">Old browser!</div><div class="comments"><p>{long} 5.</p></div></article><footer>f</footer></body></html>"""
    assert html_extract.main_text(page) == "The headline " + " ".join(f"{long} {i}." if i != 2 else f"Discussion {long} 2." for i in range(1, 5))


def test_html_clusters_decide(spark, monkeypatch):
    """Against the article element of the given pages; without names of classes too, and worse when every line is taken."""
    import html as entities
    import re

    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]

    def truth(page):
        article = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
        return " ".join(entities.unescape(re.sub(r"</?(?:h1|p|br)>", " ", article).replace("<b>", "").replace("</b>", "")).split())

    right = lambda found: np.mean([html_extract.main_text(p) == truth(p) for p in found])
    nameless = [p.replace(' class="ad"', "") for p in pages]
    assert right(pages) > 0.99 and right(nameless) > 0.9
    monkeypatch.setattr(html_extract, "clusters", lambda ratio: np.ones(len(ratio), bool))
    assert right(pages) < 0.1
    monkeypatch.setattr(html_extract, "clusters", lambda ratio: ratio > 0)
    assert right(nameless) < 0.1


def test_html_deep_pages_take_linear_time():
    import time

    began = time.time()
    for page in ("<div>" * 16_000 + "<p>text", "<div>" * 16_000 + "</span>" * 16_000 + "x", "<p>a<b>" * 16_000, "<span><article>" + "<div>" * 9000 + "</span>" * 9000 + "y"):
        assert html_extract.main_text("<body>" + page)
    assert time.time() - began < 10


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>hé</p>", "x"), (1, "u", "<p>hé</p>", "x"), (None, None, None, None)], "page_id long, url string, html string, text string").withColumn("_html", F.lit(1))
    assert sorted([tuple(r) for r in html_extract.extract(pages).select("page_id", "url", "text", "n_chars").collect()], key=str) == sorted([(1, "u", "hé", 2), (1, "u", "hé", 2), (None, None, "", 0)], key=str)
    assert html_extract.extract(pages.where("false")).count() == 0


# --- 10: WARC -------------------------------------------------------------------------------------------------------


def test_warc_round_trip_and_audit(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>page {i} é</p>" * (i % 7)) for i in range(40)], "page_id long, url string, html string")
    records = warc.to_records(pages, ids_per_file=16)
    warc.write_warc(records, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w"))
    assert sorted((r.url, bytes(r.body).decode()) for r in back.collect()) == sorted((r.url, r.html) for r in pages.collect())
    plan = warc.manifest(records)
    assert {r.digest for r in back.collect()} == {r.digest for r in plan.collect()}
    assert warc.audit(plan, plan).count() == 0
    broken = plan.where("page_id <> 5").withColumn("digest", F.when(F.col("page_id") == 20, "bad").otherwise(F.col("digest")))
    found = warc.audit(plan, broken.union(plan.where("page_id = 39").withColumn("offset", F.col("offset") + 100_000)))
    offset = {r.page_id: (r.file, r.offset) for r in plan.collect()}
    assert sorted(tuple(r)[:3] for r in found.collect()) == sorted([(*offset[5], "missing"), (*offset[20], "corrupt"), (offset[39][0], offset[39][1] + 100_000, "extra")])


def test_warc_awkward(spark):
    pages = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "")], "page_id long, url string, html string")
    plan = warc.manifest(warc.to_records(pages))
    assert plan.count() == 3 and warc.audit(plan, plan).count() == 0
    assert {r.status for r in warc.audit(plan, plan.where("false")).collect()} == {"missing"}
