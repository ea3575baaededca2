"""The thin queries over the operators, with the columns and parameters their contracts fix, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, exact_dedup, langid, language_model, mixing, packing, quality, simhash, url_filter, warc
from .common import held_out, read_table, stable

RULES = (
    url_filter.Rule("allow", "com/"),
    url_filter.Rule("block", "example.com/en/"),
    url_filter.Rule("allow", "www.example.com/en/"),
    url_filter.Rule("block", "net/es/"),
    url_filter.Rule("block", "net/fr/"),
)
WIDTH, END_ID = 1024, 2


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_components(read_table(spark, sf_dir, "embeddings"), cosine=0.98)


def language_profiles(docs: DataFrame) -> langid.Profiles:
    return langid.learn_profiles(docs.filter(~held_out("doc_id", 4, 2)))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.predict_languages(docs.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "text"), language_profiles(docs))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), "text")
    return language_model.language_model_scores(docs, "NOT held_out", carry=("held_out",))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.content_sort_dedup(read_table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read_table(spark, sf_dir, "pages"), RULES).drop("glob")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "text")
    table = stable(quality.features(docs), "features")  # texts are read once, for learning and scoring
    positives = read_table(spark, sf_dir, "labels").filter(~held_out("doc_id", 5, 0) & (F.col("quality") == 1))
    return quality.score_from(table, quality.learn_from(table.filter("NOT held_out"), positives), threshold=0.3)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents")).drop("copies")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(read_table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path(), END_ID, WIDTH)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read_table(spark, sf_dir, "documents"), shingle=3, radius=2)


QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_language_id": op2_language_id,
    "op3_language_model": op3_language_model,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_quality": op6_quality,
    "op7_mixing": op7_mixing,
    "op8_warc": op8_warc,
    "op9_packing": op9_packing,
    "op10_simhash": op10_simhash,
}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op1_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
        g AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a, min(b) AS least FROM r GROUP BY a),
        n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(c.least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c.least, vec_id)) AS kept
        FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
    """,
    "op4_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOW} AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
    """,
    "op5_url_filter": r"""
        WITH u AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        fit AS (
            SELECT page_id, host, path, verdict, rhost || rpath AS rule,
                   row_number() OVER (PARTITION BY page_id, host, path ORDER BY CASE WHEN rhost IS NULL THEN 0 ELSE length(rhost || rpath) END DESC) AS nth
            FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
        SELECT page_id, host, path, rule,
               coalesce(verdict, CASE WHEN regexp_matches(host || path, '(?s)^(spam[^/]*|[^/]*spam-.*|[^/]*-spam[^/]*|[^/]*\.spam[^/]*|[^/]*casino.*|[^/]*porn.*|[^/]*\.xxx|[^/]*\.xxx/.*|.*/wp-login\.php)$')
                                      THEN 'block' ELSE 'allow' END) AS verdict
        FROM fit WHERE nth = 1
    """,
    "op7_mixing": r"""
        WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        n AS (SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS w FROM s),
        l AS (SELECT *, source_size / w AS fill,
                     (sum(source_size) OVER () * 1.5::DOUBLE - 2 * coalesce(sum(source_size) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
              FROM n WINDOW o AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f AS (SELECT level AS first FROM l WHERE level * w <= 2 * source_size ORDER BY fill, source NULLS LAST LIMIT 1),
        t AS (SELECT source, source_size, least(coalesce((SELECT first FROM f) * w, 2.0::DOUBLE * source_size), 2.0::DOUBLE * source_size)::DOUBLE AS target,
                     ('0x' || substr(md5('mix' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM l),
        r AS (SELECT d.*, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
                     row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS FIRST) AS k
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, (least(2, floor(u + k * rate) - floor(u + (k - 1) * rate)) * size)::BIGINT AS taken FROM r
    """,
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
        k AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS keep FROM p),
        b AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 ((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS digest FROM k)
        SELECT page_id, strlen(html) AS payload_bytes, digest AS payload_digest,
               CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keep THEN keep END AS refers_to
        FROM b
    """,
}
