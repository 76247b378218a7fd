"""Queries of the training-data operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlake.llm import decontaminate, fingerprint, html_extract, langid, minhash_dedup, ngram_join, packing, phrases, quality, sharding, toxicity, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by a model of the labels outside the held-out fold. Null and empty texts score as texts without a passage;
    rows with a null or repeated doc_id each get their own score (a null is in no fold); only the text is an input of a score."""
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train(documents, labels.where(~toxicity.held_out(4, 2)))
    scored = toxicity.score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out(4, 2).alias("held_out"), "score", "predicted")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 by the law ``key``. Null texts count 16 bytes; a null doc_id is a key like any other; repeated
    rows share a shard and get slots of their own."""
    return sharding.assign(_table(spark, sf_dir, "documents"), shards=40)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces in bins of 2,048 words; null and wordless texts are pieces of size 0. Ties in size go by doc_id."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text, of its edited text and likeness with the next document's. Null texts are empty; a null doc_id is
    the least; rows that share a doc_id are all kept."""
    return fingerprint.fingerprint_with_edits(_table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by the texts outside the held-out fold; null texts and texts without a letter are und. Ties go to the first
    language by name."""
    documents = _table(spark, sf_dir, "documents")
    training = langid.train(documents.where(~langid.held_out()))
    found = langid.predict(documents.select("doc_id", "text"), training)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality by the labels outside the held-out fold. Null texts score as empty ones; each row has its own score."""
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.train(documents, labels.where(~toxicity.held_out(5, 0)))
    scored = quality.score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out(5, 0).alias("held_out"), "score", "predicted")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents over links of 4-word shingle sets at 85 %. Null and empty texts link with nothing; repeated rows are kept."""
    return ngram_join.components(_table(spark, sf_dir, "documents"), words_each=4, percent=85)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 10 words in every document. Null texts have no words; items without words or id match nothing."""
    found = decontaminate.annotate(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", decontaminate.items_sha256().alias("items_sha256"), "contaminated")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; null pages give the empty text, repeated rows are kept."""
    return html_extract.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two replicas of the pages as WARC records; in the second one the first character of some bodies is damaged.
    Every record comes back with its place, its digest and what the audit says of it."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    good = warc.manifest(warc.to_records(pages))
    damaged = F.expr("if(left(md5(cast(cast(page_id as string) as binary)), 2) = '07', overlay(record placing '#' from 1 for 1), record)")
    bad = warc.manifest(warc.to_records(pages).withColumn("record", damaged))
    found = warc.audit(good, bad).select("file", "offset", "status")
    return good.join(found, ["file", "offset"], "left").select("page_id", "file", "offset", "length", "digest", F.coalesce("status", F.lit("ok")).alias("status"))


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents over links of 5-word shingle sets at 85 %, and which documents stay. Null and empty texts
    link with nothing and stay; repeated rows are kept or go together."""
    return minhash_dedup.deduplicate(_table(spark, sf_dir, "documents"), words_each=5, percent=85)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 best phrases of all documents, at least 100 occurrences each. Null texts are empty, a null lang is und;
    repeated rows count as they stand; ties go by count and phrase."""
    return phrases.mine(_table(spark, sf_dir, "documents"), top_k=2000, least=100)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the 16 leading whitened components of the distinct ones. Rows with null vectors, or null or non-finite entries, are
    dropped; repeated rows are kept."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), components=16)


def queries() -> dict:
    found = (op1_toxicity, op2_sharding, op3_packing, op4_fingerprints, op5_language, op6_quality, op7_ngram_join, op8_decontamination, op9_html, op10_warc_audit, op11_minhash_dedup)
    found = (*found, op12_phrases, op13_whitening)
    return {f.__name__: f for f in found}


_NORMAL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{words}')"

_COMPONENTS = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_NORMAL.format(words="[^ \\t\\n\\x0B\\f\\r]+")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {{each}} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {{each}} + 2), lambda i: array_to_string(w[i:i + {{each}} - 1], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id{{more}} FROM documents d JOIN m ON m.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

ORACLE_SQL = {
    "op7_ngram_join": _COMPONENTS.format(each=4, more=""),
    "op11_minhash_dedup": _COMPONENTS.format(each=5, more=", d.doc_id = m.c AS kept"),
    "op8_decontamination": f"""
WITH d AS (SELECT doc_id, {_NORMAL.format(words="[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_NORMAL.format(words="[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")} AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g FROM b, range(1, 1000000) t(i)
        WHERE len(w) > 0 AND i <= greatest(len(w) - 9, 1)),
sizes AS (SELECT DISTINCT n FROM v),
o AS (SELECT d.doc_id, i, v.n, v.item_id FROM d, sizes, unnest(range(1, len(w) - sizes.n + 2)) t(i) JOIN v ON v.n = sizes.n AND v.g = array_to_string(w[i:i + sizes.n - 1], ' ')),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM o) GROUP BY doc_id),
k AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM o GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)
""",
    "op10_warc_audit": """
WITH r AS (SELECT page_id, CAST(floor(page_id / 512) AS BIGINT) AS file, html, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:x-page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html'
    || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages),
x AS (SELECT page_id, file, CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS digest, sha256('#' || record[2:]) AS other FROM r)
SELECT page_id, file, CAST(coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
       length, digest, CASE WHEN left(md5(CAST(page_id AS VARCHAR)), 2) = '07' AND digest <> other THEN 'corrupt' ELSE 'ok' END AS status
FROM x
""",
}


ORACLE_SQL["op12_phrases"] = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM d),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS p, count(*) AS f FROM w, range(1, 6) t(m), unnest(range(1, len(w) - m + 2)) u(i) GROUP BY lang, m, p),
c AS (SELECT lang, m, p, f AS a, string_split(p, ' ') AS v FROM g WHERE m >= 2 AND f >= 100),
k AS (SELECT c.lang, c.m, c.p, a, n, l.f AS l, r.f AS r, k, (CAST(1000 AS HUGEINT) * a * n) // (CAST(l.f AS HUGEINT) * r.f) AS score FROM c JOIN n ON n.lang = c.lang, unnest(range(1, c.m)) u(k)
        JOIN g l ON l.lang = c.lang AND l.p = array_to_string(v[1:k], ' ') JOIN g r ON r.lang = c.lang AND r.p = array_to_string(v[k + 1:], ' ')),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
s AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c q WHERE q.lang = b.lang AND q.m > b.m AND 100 * q.a >= 100 * b.a AND contains(' ' || q.p || ' ', ' ' || b.p || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM s
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
