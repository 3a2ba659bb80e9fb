"""Queries of the llm subpackage: pN_ for problem N."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.llm import conversations, encoding, language, mixing, packing, pairs, personal, repeated, scanned, tokens
from loomdoc.session import table


def _sample(spark: SparkSession, sf_dir: str) -> dict[str, list[str]]:
    return language.labelled_sample(table(spark, sf_dir, "kpi_test_questions"), "question_id", "question", "language")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.broken_pairs(table(spark, sf_dir, "query_log"), _sample(spark, sf_dir)).select("id", "defect")


def p1_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.broken_pairs(table(spark, sf_dir, "query_log"), _sample(spark, sf_dir)).groupBy("defect", "feedback").agg(F.count("*").alias("pairs"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.repair_scanned(table(spark, sf_dir, "scanned_pages")).select("page_id", F.explode("found").alias("f")).select("page_id", "f.line_no", "f.kind", "f.word")


def p2_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.repair_scanned(table(spark, sf_dir, "scanned_pages")).select("page_id", "text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.rebuild_conversations(table(spark, sf_dir, "session_log")).where("session_id is not null").select("session_id", "message_no", "speaker", "log_id")


def p3_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sound conversation, those rebuilt from links included."""
    said = conversations.rebuild_conversations(table(spark, sf_dir, "session_log"))
    return said.groupBy("conversation").agg(F.count("*").alias("messages"), F.countDistinct("log_id").alias("log_rows"), F.max(F.length("text")).alias("longest"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.repair_encoding(table(spark, sf_dir, "chunks"), "chunk_id", "page_content").select("chunk_id", "restored_md5")


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.repair_encoding(table(spark, sf_dir, "chunks"), "chunk_id", "page_content")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated.repeated_lines(table(spark, sf_dir, "chunks"), "chunk_id", "source", "page_content").select("chunk_id", "line_no")


def p5_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated.without_repeated_lines(table(spark, sf_dir, "chunks"), "chunk_id", "source", "page_content")


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "query_log").select(F.col("id").alias("record_id"), F.col("query").alias("text"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("labelled"))
    questions = table(spark, sf_dir, "kpi_test_questions").select(F.concat(F.lit("q"), F.col("question_id").cast("string")).alias("record_id"), F.col("question").alias("text"), F.col("language").alias("label"), F.lit(True).alias("labelled"))
    return language.label_languages(logs.unionByName(questions), _sample(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir).select("record_id", "segment_no", "language")


def p6_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir).select("record_id", "segment_no", "language", "confidence")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return packing.pack(tokens.with_tokens(documents, "text", ["doc_id"]), table(spark, sf_dir, "context_windows"), "doc_id", rows=documents.count())


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(p7_containers(spark, sf_dir), table(spark, sf_dir, "context_windows"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    documents = table(spark, sf_dir, "documents").join(F.broadcast(targets.select("source")), "source", "left_semi")
    return mixing.mix(tokens.with_tokens(documents, "text", ["doc_id", "source"]), targets, "doc_id")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(p8_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def _secret(spark: SparkSession) -> str:
    """The key of the surrogates: a setting of the session; where there is none, one drawn for this session only."""
    return spark.conf.get("spark.loomdoc.surrogate.key", None) or _DRAWN


_DRAWN = secrets.token_hex(16)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal_items(table(spark, sf_dir, "documents"), "doc_id", "text", _secret(spark)).select("doc_id", "kind", "found_text").distinct()


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.redact(table(spark, sf_dir, "documents"), "doc_id", "text", _secret(spark))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}


def _present(c: str) -> str:
    bare = f"lower(regexp_replace({c}, '^[\\s\\x{{A0}}\\x{{200B}}-\\x{{200F}}\\x{{FEFF}}]+|[\\s\\x{{A0}}\\x{{200B}}-\\x{{200F}}\\x{{FEFF}}]+$', '', 'g'))"
    names = ", ".join("'" + x.replace("'", "''") + "'" for x in conversations.STAND_INS)
    return f"CASE WHEN regexp_matches({bare}, '[\\p{{L}}\\p{{N}}]') AND {bare} NOT IN ({names}) THEN {c} END"


_ISO = "replace(trim(timestamp), ' ', 'T')"
_AT = f"""CASE WHEN regexp_full_match(trim(timestamp), '\\d{{13}}') THEN trim(timestamp)::BIGINT * 1000 WHEN regexp_full_match(trim(timestamp), '\\d{{10}}') THEN trim(timestamp)::BIGINT * 1000000 WHEN regexp_full_match(trim(timestamp), '\\d{{16}}') THEN trim(timestamp)::BIGINT
 WHEN NOT regexp_matches(trim(timestamp), '^\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}') THEN NULL WHEN regexp_matches(trim(timestamp), '([Zz]|[+-]\\d{{2}}:?\\d{{2}})$') THEN epoch_us(TRY_CAST({_ISO} AS TIMESTAMPTZ)) ELSE epoch_us(TRY_CAST({_ISO} || 'Z' AS TIMESTAMPTZ)) - 19800000000 END"""
SQL: dict[str, str] = {
    "p3_found": f"""WITH b AS (SELECT id, session_id, timestamp, received_at, {_present('query')} AS q, {_present('response')} AS r FROM session_log WHERE id IS NOT NULL),
 o AS (SELECT *, nullif(lower(regexp_replace(session_id, '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g')), '') AS s, {_AT} AS told FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY (q IS NOT NULL)::INT + (r IS NOT NULL)::INT DESC, coalesce(length(q), 0) + coalesce(length(r), 0) DESC, timestamp IS NOT NULL DESC, received_at DESC NULLS LAST, session_id DESC NULLS LAST, timestamp DESC NULLS LAST) = 1),
 m AS (SELECT s, id, told, q IS NULL AS answers, received_at, CASE WHEN told IS NULL OR (q IS NULL AND r IS NULL) THEN [2] ELSE list_filter([CASE WHEN q IS NOT NULL THEN 0 END, CASE WHEN r IS NOT NULL THEN 1 END], lambda x: x IS NOT NULL) END AS turns FROM o WHERE s IS NOT NULL),
 n AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY coalesce(told, 0), answers, received_at, id, turn) AS message_no FROM (SELECT * EXCLUDE turns, unnest(turns) AS turn FROM m))
 SELECT s AS session_id, message_no::INT AS message_no, CASE turn WHEN 0 THEN 'user' ELSE 'assistant' END AS speaker, id AS log_id FROM n WHERE s IN (SELECT s FROM n GROUP BY s HAVING bool_and(turn = (message_no - 1) % 2) AND max(message_no) % 2 = 0)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
