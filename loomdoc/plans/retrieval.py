"""Scans, nearest neighbours, scoring, packing and citations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomdoc import lexicon
from loomdoc.functions import text as T
from loomdoc.functions import vector
from loomdoc.operators import ingest, retrieve
from loomdoc.operators.similarity import jaccard_join, nearest_set
from loomdoc.plans.catalogue import query
from loomdoc.plans.texts import sql_rules, sql_tokens, sql_topics
from loomdoc.session import table

_LATEST = "(SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY processed_date DESC NULLS LAST) = 1)"


def _chunks(spark, sf_dir):
    return ingest.latest(table(spark, sf_dir, "chunks"), "chunk_id", "processed_date")


@query("SELECT chunk_id, source, chunk_index FROM chunks WHERE source_db = 'govt' AND language = 'hi' AND role IN ('government_officer', 'vendor')")
def scan_collection_filter(spark, sf_dir):
    return table(spark, sf_dir, "chunks").where((F.col("source_db") == "govt") & (F.col("language") == "hi") & F.col("role").isin("government_officer", "vendor")).select("chunk_id", "source", "chunk_index")


@query("SELECT DISTINCT regexp_replace(source, '(?i)\\.(docx|txt)$', '.pdf') AS source FROM (SELECT source FROM chunks UNION ALL SELECT source FROM source_files UNION ALL SELECT source FROM scanned_pages)")
def source_catalogue(spark, sf_dir):
    names = [table(spark, sf_dir, t).select("source") for t in ("chunks", "source_files", "scanned_pages")]
    return names[0].union(names[1]).union(names[2]).select(T.display_source(F.col("source")).alias("source")).distinct()


@query("SELECT source, count(DISTINCT chunk_id) AS chunks, min(chunk_index) AS first_index, max(chunk_index) AS last_index FROM chunks GROUP BY source")
def chunk_count_by_source(spark, sf_dir):
    return table(spark, sf_dir, "chunks").groupBy("source").agg(F.countDistinct("chunk_id").alias("chunks"), F.min("chunk_index").alias("first_index"), F.max("chunk_index").alias("last_index"))


@query("SELECT r.role, r.source_db, coalesce(n, 0) AS chunks FROM (VALUES ('vendor','vendor'),('government_officer','govt'),('unified','all')) r(role, source_db) LEFT JOIN (SELECT source_db, count(*) AS n FROM chunks GROUP BY 1) c ON c.source_db = r.source_db")
def collection_stats(spark, sf_dir):
    roles = spark.createDataFrame([("vendor", "vendor"), ("government_officer", "govt"), ("unified", "all")], "role string, source_db string")
    return F.broadcast(roles).join(table(spark, sf_dir, "chunks").groupBy("source_db").agg(F.count("*").alias("n")), "source_db", "left").select("role", "source_db", F.coalesce("n", F.lit(0)).alias("chunks"))


@query("SELECT chunk_id, processed_date, md5(page_content) AS content_md5 FROM " + _LATEST)
def upsert_latest(spark, sf_dir):
    return _chunks(spark, sf_dir).select("chunk_id", "processed_date", F.md5("page_content").alias("content_md5"))


@query("SELECT md5(text) AS text_md5, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def dedup_first(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").groupBy(F.md5("text").alias("text_md5")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT source_db, source, chunk_id, CAST(rank AS INTEGER) AS rank FROM (SELECT source_db, source, chunk_id, row_number() OVER (PARTITION BY source_db, source ORDER BY chunk_id) AS rank FROM (SELECT DISTINCT source_db, source, chunk_id FROM chunks)) WHERE rank <= CASE WHEN regexp_matches(lower(source), 'tender|store') THEN 25 ELSE 3 END")
def source_cap(spark, sf_dir):
    by = Window.partitionBy("source_db", "source").orderBy("chunk_id")
    ranked = table(spark, sf_dir, "chunks").select("source_db", "source", "chunk_id").distinct().withColumn("rank", F.row_number().over(by)).where("rank <= 25")
    return ranked.where(F.col("rank") <= F.when(F.lower("source").rlike("tender|store"), 25).otherwise(3)).select("source_db", "source", "chunk_id", "rank")


@query("SELECT chunk_id, source FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM source_files s WHERE s.source = c.source AND NOT s.is_active)")
def exclude_deactivated(spark, sf_dir):
    off = table(spark, sf_dir, "source_files").where("not is_active").select("source")
    return table(spark, sf_dir, "chunks").select("chunk_id", "source").join(off, "source", "left_anti").select("chunk_id", "source")


_SIM = "(SELECT a.vec_id AS q, b.vec_id AS p, a.label AS ql, b.label AS pl, coalesce(round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / nullif(sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 0), 6), 0) AS sim FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 {0})"


def _search(spark, sf_dir, k):
    points = table(spark, sf_dir, "embeddings")
    return vector.nearest(points, points.where("vec_id % 20 = 0"), "vec_id", "embedding", k)


@query("SELECT q AS query_key, p AS vec_id, CAST(row_number() OVER (PARTITION BY q ORDER BY sim DESC, p) AS INTEGER) AS rank FROM " + _SIM.format("") + " QUALIFY rank <= 10")
def knn_topk(spark, sf_dir):
    return _search(spark, sf_dir, 10).select("query_key", F.col("key").alias("vec_id"), "rank")


@query("WITH r AS (SELECT q, ql, pl, row_number() OVER (PARTITION BY q ORDER BY sim DESC, p) AS rank FROM " + _SIM.format("AND a.vec_id <> b.vec_id") + "), f AS (SELECT q, ql, min(rank) FILTER (WHERE ql = pl) AS first FROM r WHERE rank <= 10 GROUP BY ALL) SELECT count(*) AS queries, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0 END), 6) AS recall_3, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_10 FROM f")
def recall_at_k(spark, sf_dir):
    return retrieve.recall(_first_hits(spark, sf_dir), [])


@query("WITH r AS (SELECT q, ql, pl, row_number() OVER (PARTITION BY q ORDER BY sim DESC, p) AS rank FROM " + _SIM.format("AND a.vec_id <> b.vec_id") + "), f AS (SELECT q, ql, min(rank) FILTER (WHERE ql = pl) AS first FROM r WHERE rank <= 10 GROUP BY ALL) SELECT ql AS label, count(*) AS queries, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0 END), 6) AS recall_3, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_10 FROM f GROUP BY ql")
def recall_by_source(spark, sf_dir):
    return retrieve.recall(_first_hits(spark, sf_dir), ["label"])


def _first_hits(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    near = _search(spark, sf_dir, 11).where("query_key != key")
    rank = F.row_number().over(Window.partitionBy("query_key").orderBy(F.desc("similarity"), "key"))
    near = near.withColumn("rank", rank).where("rank <= 10")
    named = near.join(labels.select(F.col("vec_id").alias("key"), F.col("label").alias("found")), "key").join(labels.select(F.col("vec_id").alias("query_key"), "label"), "query_key")
    return named.groupBy("query_key", "label").agg(F.min(F.when(F.col("found") == F.col("label"), F.col("rank"))).alias("first"))


_Q = "(SELECT DISTINCT question_id, question, source_file FROM kpi_test_questions WHERE question_id % 20 = 0)"


@query(f"SELECT question_id, list_aggregate(list_distinct(list_concat([question], list_transform({sql_topics('question')}, lambda t: question || ' ' || t), list_transform({sql_rules('question')}, lambda r: 'Rule ' || r))), 'count') AS sub_queries FROM (SELECT DISTINCT question_id, question FROM kpi_test_questions)")
def expand_queries(spark, sf_dir):
    questions = table(spark, sf_dir, "kpi_test_questions").select("question_id", "question").dropDuplicates()
    return questions.select("question_id", F.size(retrieve.sub_queries(F.col("question"))).cast("long").alias("sub_queries"))


_SCORED = f"""(SELECT q.question_id, c.chunk_id, c.source_db, c.source, len(list_intersect(qt, ct)) + 20 * len(list_intersect(qr, cr)) + 5 * len(list_intersect(qtop, ctop)) AS score FROM
 (SELECT question_id, source_file, {sql_tokens('question')} AS qt, list_distinct({sql_rules('question')}) AS qr, {sql_topics('question')} AS qtop FROM {_Q}) q JOIN
 (SELECT chunk_id, source_db, source, {sql_tokens('page_content')} AS ct, list_distinct(regexp_extract_all(lower(page_content), '(?:rule|ru1e|clause|section|chapter|नियम|खंड|अध्याय) ?(\\d+)', 1)) AS cr, {sql_topics('page_content')} AS ctop FROM {_LATEST}) c ON c.source = q.source_file)"""


@query(f"SELECT question_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM {_SCORED} QUALIFY rank <= 7")
def retrieve_topk(spark, sf_dir):
    questions = table(spark, sf_dir, "kpi_test_questions").where("question_id % 20 = 0").select("question_id", "question", F.col("source_file").alias("source")).dropDuplicates()
    return retrieve.scored(questions, _chunks(spark, sf_dir), 7, "source")


@query(f"""SELECT question_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM {_SCORED.replace('c ON c.source = q.source_file)', 'c ON true)')} QUALIFY rank <= 7""")
def retrieve_topk_all(spark, sf_dir):
    questions = table(spark, sf_dir, "kpi_test_questions").where("question_id % 20 = 0").select("question_id", "question").dropDuplicates()
    return retrieve.scored_all(questions, _chunks(spark, sf_dir), 7)


_EDITIONS = _SCORED.replace(_Q, "(SELECT DISTINCT question_id, question, unnest([source_file, regexp_replace(source_file, '\\.pdf$', '_Hindi.pdf')]) AS source_file FROM kpi_test_questions WHERE question_id % 20 = 0)")


@query(f"SELECT question_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM {_EDITIONS} QUALIFY rank <= 7")
def merged_editions(spark, sf_dir):
    """The best chunks of a question's document and of its Hindi edition, merged by score."""
    questions = table(spark, sf_dir, "kpi_test_questions").where("question_id % 20 = 0").select("question_id", "question", "source_file").dropDuplicates()
    both = questions.select("question_id", "question", F.explode(F.array("source_file", F.regexp_replace("source_file", r"\.pdf$", "_Hindi.pdf"))).alias("source")).distinct()
    by = Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")  # the best seven of two documents
    return retrieve.scored(both, _chunks(spark, sf_dir), 7, "source").withColumn("rank", F.row_number().over(by)).where("rank <= 7")


@query(f"""WITH m AS (SELECT DISTINCT source_db, source, file_path, chunk_index, chunk_id, regexp_matches(lower(page_content), '(rule|नियम) 1\\d\\d([^0-9]|$)') AS hit FROM {_LATEST})
 SELECT DISTINCT c.chunk_id FROM m c JOIN m h ON c.source_db = h.source_db AND c.source = h.source AND c.file_path = h.file_path AND c.chunk_index BETWEEN h.chunk_index AND h.chunk_index + 2 WHERE h.hit""")
def rule_filter_continuation(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    return retrieve.with_continuation(chunks, F.lower("page_content").rlike(r"(rule|नियम) 1\d\d([^0-9]|$)")).select("chunk_id")


@query(f"""WITH s AS (SELECT source_db, file_path, chunk_id, least(length(page_content), {lexicon.CHUNK_CHARS}) AS n, coalesce(sum(least(length(page_content), {lexicon.CHUNK_CHARS})) OVER (PARTITION BY source_db, file_path ORDER BY chunk_index, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {_LATEST})
 SELECT source_db, file_path, chunk_id, CAST(CASE WHEN before + n <= {lexicon.CONTEXT_CHARS} THEN n ELSE {lexicon.CONTEXT_CHARS} - before END AS BIGINT) AS taken FROM s WHERE before + n <= {lexicon.CONTEXT_CHARS} OR (before <= {lexicon.CONTEXT_CHARS} AND {lexicon.CONTEXT_CHARS} - before > {lexicon.LEAST_REST})""")
def context_pack(spark, sf_dir):
    return retrieve.pack_context(_chunks(spark, sf_dir), ["source_db", "file_path"], "chunk_index", "chunk_id", "page_content")


@query(f"""WITH p AS (SELECT id, role, response_time_seconds, list_transform(regexp_extract_all(coalesce(response,''), '(?:Page|page|पृष्ठ) (\\d+)', 1), lambda p: p::INT) AS pages FROM (SELECT DISTINCT id, role, response, response_time_seconds FROM query_log))
 SELECT role, count(*) AS answers, count(DISTINCT pg) AS pages, min(pg) AS first_page, max(pg) AS last_page FROM (SELECT id, role, unnest(pages) AS pg FROM p) GROUP BY role""")
def source_pages(spark, sf_dir):
    answers = table(spark, sf_dir, "query_log").select("id", "role", "response", "response_time_seconds").dropDuplicates()
    named = F.transform(F.regexp_extract_all(F.coalesce("response", F.lit("")), F.lit(r"(?:Page|page|पृष्ठ) (\d+)"), F.lit(1)), lambda p: p.cast("int"))
    return answers.select("role", F.explode(named).alias("pg")).groupBy("role").agg(F.count("*").alias("answers"), F.countDistinct("pg").alias("pages"), F.min("pg").alias("first_page"), F.max("pg").alias("last_page"))


@query("SELECT source_file, count(*) AS questions, bool_or(EXISTS (SELECT 1 FROM chunks c WHERE c.source = k.source_file AND c.source_db = 'vendor')) AS vendor_source FROM kpi_test_questions k GROUP BY source_file")
def category_semi(spark, sf_dir):
    vendor = table(spark, sf_dir, "chunks").where("source_db = 'vendor'").select(F.col("source").alias("source_file"), F.lit(True).alias("v")).distinct()
    return table(spark, sf_dir, "kpi_test_questions").groupBy("source_file").agg(F.count("*").alias("questions")).join(vendor, "source_file", "left").select("source_file", "questions", F.coalesce("v", F.lit(False)).alias("vendor_source"))


@query("SELECT part, count(*) AS n FROM (SELECT source, 'vendor' AS part FROM chunks WHERE source_db = 'vendor' UNION ALL SELECT source, 'govt' FROM chunks WHERE source_db = 'govt') GROUP BY part UNION ALL SELECT 'names', count(*) FROM (SELECT source FROM chunks UNION SELECT source FROM scanned_pages)")
def union_stores(spark, sf_dir):
    chunks = table(spark, sf_dir, "chunks")
    both = chunks.where("source_db = 'vendor'").select(F.lit("vendor").alias("part")).unionByName(chunks.where("source_db = 'govt'").select(F.lit("govt").alias("part")))
    names = chunks.select("source").union(table(spark, sf_dir, "scanned_pages").select("source")).distinct()
    return both.groupBy("part").agg(F.count("*").alias("n")).unionByName(names.agg(F.count("*").alias("n")).select(F.lit("names").alias("part"), "n"))


@query("SELECT d.doc_id, c.vec IS NOT NULL AS cached FROM documents d LEFT JOIN (SELECT DISTINCT sha256(text) AS h, 1 AS vec FROM documents WHERE doc_id % 2 = 0) c ON sha256(d.text) = c.h")
def cache_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    cache = docs.where("doc_id % 2 = 0").select(F.sha2("text", 256).alias("h"), F.lit(1).alias("vec")).distinct()
    return docs.select("doc_id", F.sha2("text", 256).alias("h")).join(cache, "h", "left").select("doc_id", F.col("vec").isNotNull().alias("cached"))


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT l.id, min(k.question_id) AS question_id FROM query_log l JOIN kpi_test_questions k ON lower({_STRIP.format('l.query')}) = lower({_STRIP.format('k.question')}) GROUP BY l.id")
def override_exact(spark, sf_dir):
    key = lambda c: F.lower(T.strip(F.col(c)))
    overrides = table(spark, sf_dir, "kpi_test_questions").groupBy(key("question").alias("q")).agg(F.min("question_id").alias("question_id"))
    return table(spark, sf_dir, "query_log").select("id", key("query").alias("q")).join(overrides, "q").groupBy("id").agg(F.min("question_id").alias("question_id"))


@query(f"""WITH l AS (SELECT DISTINCT id, {sql_tokens('query')} AS a FROM query_log), k AS (SELECT DISTINCT question_id, {sql_tokens('question')} AS b FROM kpi_test_questions WHERE question_id % 20 = 0),
 s AS (SELECT id, question_id, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE AS sim FROM l, k WHERE len(a) > 0 AND len(b) > 0)
 SELECT id, arg_min(question_id, struct_pack(s := -sim, q := question_id)) AS question_id, round(max(sim), 6) AS similarity FROM s WHERE sim >= {lexicon.FUZZY} GROUP BY id""")
def override_fuzzy(spark, sf_dir):
    log = table(spark, sf_dir, "query_log").select(F.col("id").alias("key"), T.tokens(F.col("query")).alias("tokens")).dropDuplicates()
    overrides = table(spark, sf_dir, "kpi_test_questions").where("question_id % 20 = 0").select(F.col("question_id").alias("key"), T.tokens(F.col("question")).alias("tokens")).dropDuplicates()
    near = jaccard_join(log, overrides, lexicon.FUZZY)
    return near.groupBy(F.col("l").alias("id")).agg(F.min_by("r", F.struct(-F.col("similarity"), "r")).alias("question_id"), F.round(F.max("similarity"), 6).alias("similarity"))


@query()
def override_fuzzy_all(spark, sf_dir):
    log = table(spark, sf_dir, "query_log").select(F.col("id").alias("key"), T.tokens(F.col("query")).alias("tokens"))
    overrides = table(spark, sf_dir, "kpi_test_questions").select(F.col("question_id").alias("key"), T.tokens(F.col("question")).alias("tokens"))
    return nearest_set(log, overrides, lexicon.FUZZY)


@query(f"""WITH d AS (SELECT id, {sql_tokens('max(query)')} AS a, {sql_tokens('max(response)')} AS ra FROM query_log WHERE lower({_STRIP.format('feedback')}) = 'unsatisfied' GROUP BY id), k AS (SELECT DISTINCT question_id, {sql_tokens('question')} AS b, {sql_tokens('ground_truth_context')} AS rb FROM kpi_test_questions WHERE question_id % 20 = 0)
 SELECT question_id, count(*) AS dislikes, -50 * count(*) AS penalty FROM d, k WHERE len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE > 0.4 AND len(list_intersect(ra, rb)) / nullif(len(list_distinct(list_concat(ra, rb))), 0)::DOUBLE > 0.3 GROUP BY question_id""")
def dislike_penalty(spark, sf_dir):
    disliked = table(spark, sf_dir, "query_log").where(F.lower(T.strip(F.col("feedback"))) == "unsatisfied").groupBy("id").agg(F.max("query").alias("query"), F.max("response").alias("response"))
    questions = table(spark, sf_dir, "kpi_test_questions").where("question_id % 20 = 0").select("question_id", "question", "ground_truth_context").dropDuplicates()
    return retrieve.dislike_penalty(disliked, questions)
