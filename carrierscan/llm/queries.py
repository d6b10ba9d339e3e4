"""The operators' registered queries, with SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carrierscan.llm import ann, gif, jaccard, langid, lloyd, mixing, packing, pivots, sharding, toxicity, urlfilter, warc, whitening

URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, folds: int) -> Column:
    """Remainder of the CRC-32 of an id's text."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def tokenizer() -> dict[str, str]:
    """The packing tokenizer's file, and its vocabulary as ranks."""
    import public_tokenizers

    return {"tokenizer_path": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op1_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op2_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_pages(_table(spark, sf_dir, "pages"))
    return read.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op3_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op4_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    scored = toxicity.score_texts(docs, model, ["doc_id"])
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_pred").alias("predicted"), F.size("toxic_passages").alias("passages"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digests(_table(spark, sf_dir, "documents"), **tokenizer())


def op6_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit_languages(docs.where(fold("doc_id", 4) != 2))
    named = langid.predict_languages(docs, model, ["doc_id"])
    return named.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op7_gif_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from carrierscan.llm.common import materialize

    stored = materialize(gif.text_media(_table(spark, sf_dir, "documents")), "media")
    frames = gif.decode_frames(stored, joined=True)
    total = F.aggregate("frames", F.array_repeat(F.lit(0), 24), lambda got, f: F.zip_with(got, f["histogram"], lambda a, b: a + b))
    last = F.element_at("frames", -1)
    feature = F.concat(F.lit("frames="), F.size("frames"), F.lit(" ms="), last["at_ms"] + last["delay_ms"], F.lit(" red="), F.array_join(F.slice(total, 1, 8), ","))
    rows = frames.select("doc_id", "n_bytes", F.col("samples").alias("_payload"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))
    return rows.select(
        "doc_id", "n_bytes", F.octet_length("_payload").cast("long").alias("payload_bytes"), F.sha2("_payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(_payload, -32, 32)")).alias("tail_crc32"), "media_bytes", "media_sha256", "feature",
    )


def op8_prefix_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op9_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shard_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return shards.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op11_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_products(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_chan_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_hamerly_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.vector_codes(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_collision_ann, op2_warc_dictionary, op3_bloom_cascade, op4_toxic_segments, op5_best_fit_packing, op6_language_bitmask, op7_gif_frames, op8_prefix_jaccard, op9_histogram_shards, op10_entropy_mix,
        op11_pivot_topk, op12_chan_whitening, op13_hamerly_codes,
    )
}



def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd rounds as one step of SQL for each: nearest entries by whole-number distances, then floors of means."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
        a{k} AS MATERIALIZED (
            SELECT r, p, min_by(e, d * {entries} + e) AS e, min(d) AS d FROM (
                SELECT v.r, v.p, b.e, sum((v.x - b.x) * (v.x - b.x)) AS d FROM v JOIN b{k} b ON v.p = b.p AND v.i = b.i GROUP BY ALL
            ) GROUP BY ALL
        )""")
        if k < rounds:
            steps.append(f"""
        b{k + 1} AS MATERIALIZED (
            SELECT b.p, b.e, b.i, CAST(coalesce(any_value(m.x), any_value(b.x)) AS BIGINT) AS x
            FROM b{k} b LEFT JOIN (
                SELECT v.p, a.e, v.i, floor(sum(v.x) / count(*)) AS x FROM v JOIN a{k} a ON v.r = a.r AND v.p = a.p GROUP BY ALL
            ) m ON b.p = m.p AND b.e = m.e AND b.i = m.i GROUP BY ALL
        )""")
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda c: CAST(floor(4096 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
        ), v AS MATERIALIZED (
            SELECT r, (i - 1) // (n // {parts}) AS p, (i - 1) % (n // {parts}) AS i, x FROM (SELECT r, len(x) AS n, unnest(x) AS x, unnest(range(1, len(x) + 1)) AS i FROM kept)
        ), b0 AS MATERIALIZED (
            SELECT p, r - 1 AS e, i, x FROM v WHERE r <= {entries}
        ), {",".join(steps)}, c AS (
            SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r
        ), l AS (
            SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM kept JOIN c USING (r) GROUP BY label
        )
        SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) FROM b{rounds}) AS codebooks_sha256
        FROM kept JOIN c USING (r) JOIN l ON kept.label IS NOT DISTINCT FROM l.label
    """


ORACLE_SQL: dict[str, str] = {
    "op2_warc_dictionary": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), m AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM m
    """,
    "op3_bloom_cascade": """
        WITH r AS (
            SELECT * FROM (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')) t(rhost, rpath, rverdict)
        ), s AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), u AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s
        ), f AS (
            SELECT u.page_id, rhost || rpath AS rule, rverdict, row_number() OVER (PARTITION BY u.page_id ORDER BY length(rhost || rpath) DESC) AS k
            FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
        )
        SELECT u.page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(rverdict, 'allow') AS verdict
        FROM u LEFT JOIN f ON u.page_id = f.page_id AND k = 1
    """,
    "op11_pivot_topk": """
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(64 * CAST(c AS DOUBLE))) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
        ), s AS (
            SELECT q.r, q.vec_id AS query_id, v.vec_id, v.r AS other, CAST(list_dot_product(q.x, v.x) AS BIGINT) AS score FROM kept q JOIN kept v ON q.vec_id % 20 = 0 AND v.r <> q.r
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 20
    """,
    "op13_hamerly_codes": _codes_sql(),
}
