"""Questions through the whole of retrieval, and the queries that go with it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomdoc import lexicon
from loomdoc.functions import text as T
from loomdoc.operators import ingest, retrieve
from loomdoc.plans.catalogue import query
from loomdoc.plans.texts import sql_cut, sql_rules, sql_spelled, sql_tokens, sql_topics
from loomdoc.session import table

_LATEST = "(SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY processed_date DESC NULLS LAST) = 1)"
_ASKED = "(SELECT DISTINCT question_id, question FROM kpi_test_questions WHERE question_id % 20 = 0)"
_CITED = "list_distinct(regexp_extract_all(lower({}), '(?:rule|ru1e|clause|section|chapter|नियम|खंड|अध्याय) ?(\\d+)', 1))"
_MENTIONED = "list_filter(regexp_extract_all(lower(concat_ws(' ', page_content, original_hindi)), '" + T.MENTION + "', 1), lambda n: regexp_full_match(n, '\\p{Nd}+'))"
#: Rules in order: list_distinct does not keep it, so that the first of equal ones is looked up.
_ORDERED = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_SUBS = f"""list_concat([n], list_transform(qs, lambda t: n || ' ' || t), flatten(list_transform(qr, lambda r: CASE WHEN regexp_full_match(r, '1\\d\\d') THEN ['Rule ' || r, 'नियम ' || r, 'Rule 4' || r[2:3], 'नियम 4' || r[2:3]] ELSE ['Rule ' || r, 'नियम ' || r] END)))"""
_SEARCH = f"""WITH a AS (SELECT question_id, n, {_ORDERED.format('rs')} AS qr, qs FROM (SELECT question_id, n, {sql_rules('n')} AS rs, {sql_topics('n')} AS qs FROM (SELECT question_id, {sql_spelled('question')} AS n FROM {_ASKED}))),
 l AS (SELECT question_id, {_ORDERED.format('l')} AS l FROM (SELECT question_id, {_SUBS} AS l FROM a)),
 s AS (SELECT question_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS sub FROM l),
 f AS MATERIALIZED (SELECT text, {sql_tokens('text')} AS qt, list_distinct({sql_rules('text')}) AS qr, {sql_topics('text')} AS qs FROM (SELECT DISTINCT text FROM s)),
 c AS MATERIALIZED (SELECT chunk_id, source_db, regexp_replace(source, '(?i)\\.(docx|txt)$', '.pdf') AS source, chunk_index, page_content, original_hindi, {sql_tokens('page_content')} AS ct, {_CITED.format('page_content')} AS cr, {sql_topics('page_content')} AS cs FROM {_LATEST}),
 m AS (SELECT text, chunk_id, source_db, row_number() OVER (PARTITION BY text, source_db ORDER BY len(list_intersect(qt, ct)) + 20 * len(list_intersect(qr, cr)) + 5 * len(list_intersect(qs, cs)) DESC, chunk_id) AS rank FROM f, c QUALIFY rank <= 40),
 h AS (SELECT question_id, chunk_id, min({{'store': CASE source_db WHEN 'vendor' THEN 0 ELSE 1 END, 'sub': sub, 'rank': rank, 'chunk_id': chunk_id}}) AS found FROM s JOIN m USING (text) GROUP BY question_id, chunk_id),
 k AS (SELECT h.question_id, h.found, c.* FROM h JOIN c USING (chunk_id) QUALIFY row_number() OVER (PARTITION BY question_id, source ORDER BY found) <= CASE WHEN regexp_matches(lower(source), 'gfr|store purchase|cg hindi') THEN 25 ELSE 3 END),
 r AS (SELECT k.*, len(list_intersect({sql_tokens('n')}, ct)) + 20 * len(list_intersect(a.qr, cr)) + 5 * len(list_intersect(a.qs, cs)) AS score,
  regexp_matches(n, '[0-9]') AND list_has_any({_MENTIONED}, list_concat(a.qr, list_transform(list_filter(a.qr, lambda r: regexp_full_match(r, '1\\d\\d')), lambda r: '4' || r[2:3]))) AS hit FROM k JOIN a USING (question_id)),
 g AS (SELECT r.* FROM r WHERE NOT EXISTS (SELECT 1 FROM r x WHERE x.question_id = r.question_id AND x.hit) OR EXISTS (SELECT 1 FROM r x WHERE x.question_id = r.question_id AND x.hit AND x.source = r.source AND r.chunk_index BETWEEN x.chunk_index AND x.chunk_index + 2)),
 b AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, found) AS rank FROM g QUALIFY rank <= 10),
 z AS (SELECT *, length({sql_cut('page_content', 'head')}) AS size FROM (SELECT *, substring(page_content, 1, {lexicon.CHUNK_CHARS}) AS head FROM b)),
 w AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY question_id ORDER BY source, chunk_index, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM z)
 SELECT question_id, CAST(rank AS INTEGER) AS rank, chunk_id, source_db, source, CAST(score AS BIGINT) AS score, CAST(CASE WHEN before + size <= {lexicon.CONTEXT_CHARS} THEN size WHEN {lexicon.CONTEXT_CHARS} - before > {lexicon.LEAST_REST} THEN {lexicon.CONTEXT_CHARS} - before ELSE 0 END AS BIGINT) AS taken FROM w"""


def _chunks(spark, sf_dir):
    return ingest.latest(table(spark, sf_dir, "chunks"), "chunk_id", "processed_date")


@query(_SEARCH)
def answer_context(spark, sf_dir):
    """From question to context: search queries, two stores, dedup, cap by source, score, rule filter, best ten, packing."""
    questions = table(spark, sf_dir, "kpi_test_questions").where("question_id % 20 = 0").select("question_id", "question").dropDuplicates()
    return retrieve.search(questions, _chunks(spark, sf_dir))
