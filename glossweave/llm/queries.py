"""The operators of this subpackage as registered queries over the driver's tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, id_store, kdtree, language_id, lm_bloom, near_dedup, packing, token_counts, url_templates, warc
from .storage import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a passage of the benchmark, with the item and how closely it matches."""
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: A document's first ids, which are guessed from nothing but each other, bear no loss; at most so many of a sequence's ids do.
CONTEXT, LIMITS = 16, packing.Limits(tokens=4096, segments=64, loss=4096 - 16)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), limits=LIMITS, prompt_tokens=CONTEXT)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, found by scanning the flat files that they were written to."""
    path = new_path(spark, "flat")
    order = token_counts.write_flat(_table(spark, sf_dir, "documents"), path)
    counts = token_counts.scan(spark, path, end_id=49407, width=2)
    return order.join(counts, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens", "closed")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, resolved = new_path(spark, "warc"), new_path(spark, "warc-resolved")
    files = warc.write_archives(_table(spark, sf_dir, "pages"), raw)
    files = warc.resolve(spark, raw, files, resolved)
    return warc.read_resolved(spark, resolved, files).drop("url")


def op5_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    store = id_store.write_store(docs, new_path(spark, "ids"))
    return id_store.lookup(store, docs, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = kdtree.quantised(_table(spark, sf_dir, "embeddings"))
    return kdtree.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.identify(docs.select("doc_id", "text"), language_id.fit(docs))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


#: The rules of the URL query.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(_table(spark, sf_dir, "pages"), RULES)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", lm_bloom.held_out(F.col("doc_id")).alias("held_out"))
    return lm_bloom.score(docs, docs.where("not held_out"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_packing": op2_packing,
    "op3_token_counts": op3_token_counts,
    "op4_warc": op4_warc,
    "op5_id_store": op5_id_store,
    "op6_top_k": op6_top_k,
    "op7_language_id": op7_language_id,
    "op8_url_filter": op8_url_filter,
    "op9_lm_score": op9_lm_score,
    "op10_near_dedup": op10_near_dedup,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Base-32 of a SHA-1 that DuckDB has as hexadecimal text: five bytes (ten digits) make eight characters.
_BASE32 = """list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST(('0x' || substr(sha1(h), 10 * (k // 8) + 1, 10))::BIGINT // (1::BIGINT << (35 - 5 * (k % 8))) % 32 AS INTEGER), 1)), 'string_agg', '')"""

ORACLE_SQL = {
    "op4_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        o AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
        SELECT page_id, strlen(h) AS payload_bytes, {_BASE32} AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first THEN first END AS refers_to
        FROM p JOIN o USING (h)""",
    "op6_top_k": """
        WITH q AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
            FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 10""",
    "op10_near_dedup": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 OR ws IS NULL THEN []
                WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
        n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
        SELECT n.doc_id, n.n AS n_shingles, m.component_id, n.doc_id = m.component_id AS kept FROM n JOIN m USING (doc_id)""",
}
