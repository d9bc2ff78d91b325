"""The registered queries opN_<name>: thin digests of the operators' outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, html, lines, media, mixing, packing, simhash, substrings, toxicity, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lines.remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return seen.select("doc_id", simhash.hex_fingerprint(seen["fp"]).alias("fingerprint"), "component_id")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(warc.dedup_plan(table(spark, sf_dir, "pages")))
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_column(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.selectExpr("doc_id", "size", "source_size", "target", "size * copies AS taken")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").selectExpr(
        "doc_id", "CAST(piece AS INT) piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(media.store_pcm(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Query] = {
    "op1_html": op1_html,
    "op2_lines": op2_lines,
    "op3_simhash": op3_simhash,
    "op4_warc": op4_warc,
    "op5_embeddings": op5_embeddings,
    "op6_toxicity": op6_toxicity,
    "op7_mixing": op7_mixing,
    "op8_substrings": op8_substrings,
    "op9_packing": op9_packing,
    "op10_media": op10_media,
}

WORDS_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

ORACLES: dict[str, str] = {
    "op2_lines": """
        WITH d AS (
            SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
        l AS (
            SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS pos FROM d),
        r AS (
            SELECT *, lead(line, 1) OVER o AS l1, lead(line, 2) OVER o AS l2, lead(line, 3) OVER o AS l3
            FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
        n AS (
            SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS nth,
                   row_number() OVER (PARTITION BY line, l1, l2, l3 ORDER BY doc_id, pos) AS nth4 FROM r),
        g AS (
            SELECT doc_id, pos FROM n WHERE nth > 1 AND length(line) >= 20
            UNION SELECT doc_id, unnest(range(pos, pos + 4)) FROM n WHERE nth4 > 1 AND l3 IS NOT NULL),
        k AS (
            SELECT l.doc_id, l.pos, l.line, g.pos IS NOT NULL AS gone FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos)
        SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
               sha256(coalesce(string_agg(CASE WHEN gone THEN NULL ELSE line END, chr(10) ORDER BY pos), '')) AS kept_sha256
        FROM k GROUP BY doc_id""",
    "op4_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (
            SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
        m AS (
            SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN last END AS refers_to
        FROM m""",
    "op7_mixing": f"""
        WITH d AS (
            SELECT doc_id, source, CAST({WORDS_SQL} AS BIGINT) AS size FROM documents),
        s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   row_number() OVER (ORDER BY source ASC NULLS LAST) AS turn FROM d GROUP BY source),
        w AS (
            SELECT *, [3, 1, 2][(turn - 1) % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
        l AS (
            SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0::DOUBLE))
                      / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
            FROM w WINDOW b AS (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (
            SELECT *, least(cap, coalesce(max(CASE WHEN level * weight < cap THEN level END) OVER () * weight, cap)) AS target FROM l),
        r AS (
            SELECT doc_id, size, source_size, target,
                   CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
                   ('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM r""",
}
