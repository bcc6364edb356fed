"""The training-data queries of the driver: operators with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stintworks.llm import chat, dedup, fingerprints, langid, licenses, mixing, neardup, packing, periodic, pii, repair, sharding, warc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def register(sql: str | None = None):
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            ORACLE[query.__name__] = sql
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register(f"""
    WITH n AS (SELECT doc_id, translate(coalesce(text, ''), {AZ}) AS norm FROM documents),
    g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
    FROM n JOIN g USING (norm)
""")
def op1_exact_dedup(spark, sf_dir):
    return dedup.exact_dedup(table(spark, sf_dir, "documents"))


@register(r"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      CAST(sum(17 + length(role || text) + length(regexp_replace(role || text, '[^~<\[]', '', 'g'))) AS BIGINT) AS formatted_chars
    FROM c GROUP BY conv_id
""")
def op4_chat_format(spark, sf_dir):
    said = "'</s>[INST] ok [/INST]'"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', {said}), (-7L, 1L, 'assistant', {said}) AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    stream, examples = chat.format_chats(turns.unionByName(extra))
    return chat.read_back(stream, examples)


@register()
def op2_pii(spark, sf_dir):
    return pii.summarize(pii.find_pii(table(spark, sf_dir, "documents")))


@register()
def op3_pack_best_fit(spark, sf_dir):
    rows = packing.pack_documents(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@register("""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
    g AS (SELECT html, max(page_id) AS keep_id FROM p WHERE payload_bytes >= 1000 GROUP BY html)
    SELECT page_id, payload_bytes, sha1(p.html) AS payload_digest,
      CASE WHEN keep_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN keep_id <> page_id THEN keep_id END AS refers_to
    FROM p LEFT JOIN g ON p.html = g.html
""")
def op5_warc(spark, sf_dir):
    archives = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.pages_of(warc.read_archives(archives, with_payload=False)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@register()
def op6_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


@register()
def op7_license_scan(spark, sf_dir):
    return licenses.summarize(licenses.scan_licenses(table(spark, sf_dir, "documents")))


@register()
def op8_minhash_near_dedup(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


@register()
def op9_fingerprint(spark, sf_dir):
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


@register()
def op10_mix_sources(spark, sf_dir):
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "copies")


@register()
def op11_conversation_repair(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    edits, summary = repair.repair(repair.damage(turns))
    return repair.summarize(turns, edits, summary)


@register()
def op12_balanced_shards(spark, sf_dir):
    rows = sharding.assign(table(spark, sf_dir, "documents")).withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@register()
def op13_periodic_runs(spark, sf_dir):
    return periodic.summarize(periodic.find_runs(periodic.plant_runs(table(spark, sf_dir, "documents"))))
