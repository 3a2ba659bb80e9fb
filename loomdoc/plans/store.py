"""Stored tables and what changes them: feedback, ingest, settings, sessions; reports and measures over them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomdoc import lexicon
from loomdoc.functions import text as T
from loomdoc.operators import ingest, logs, retrieve
from loomdoc.plans.catalogue import query, sql_list
from loomdoc.plans.texts import _HINGLISH, _asks, sql_spelled
from loomdoc.session import table
from loomdoc.sources import files
from loomdoc.streaming import live

_FED = "lower(regexp_replace(feedback, '^\\s+|\\s+$', '', 'g'))"
_VALID = "('neutral', 'satisfied', 'unsatisfied')"
_LAST = "(SELECT * FROM query_log QUALIFY row_number() OVER (PARTITION BY id ORDER BY received_at DESC, coalesce(response,'') DESC, coalesce(query,'') DESC) = 1)"
_LATEST = "(SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY processed_date DESC NULLS LAST) = 1)"


@query(f"SELECT id, received_at, query FROM {_LAST} WHERE upper(trim(coalesce(query, ''))) <> 'WHAT IS EMD?' ORDER BY received_at DESC, id")
def log_appended(spark, sf_dir):
    """The log with the newest first, without the entries whose question is the phrase that is not to be logged."""
    return logs.without_phrase(logs.once(table(spark, sf_dir, "query_log")), "What is EMD?").orderBy(F.desc("received_at"), "id").select("id", "received_at", "query")


@query(f"WITH e AS (SELECT id, {_FED} AS fb, received_at FROM query_log WHERE {_FED} IN {_VALID}), b AS (SELECT DISTINCT id FROM query_log) SELECT b.id, coalesce(arg_max(fb, received_at), 'neutral') AS feedback, count(fb) AS updates FROM b LEFT JOIN e ON b.id = e.id GROUP BY b.id")
def feedback_applied(spark, sf_dir):
    """The log with the last valid feedback of each entry; feedback of another kind changes nothing."""
    log = table(spark, sf_dir, "query_log")
    return logs.with_feedback(log.select("id").distinct(), log.select("id", "feedback", F.col("received_at").alias("at")))


@query(f"SELECT id, CASE WHEN {_FED} IN ('satisfied', 'unsatisfied') THEN {_FED} ELSE 'neutral' END AS feedback, md5(coalesce(response, '')) AS response_md5 FROM {_LAST}")
def live_feedback(spark, sf_dir):
    """The log as a stream of changes, each batch written once under its number and merged by id when read."""
    log = live.changed(spark, sf_dir, "query_log", "id", ["received_at", "response", "query"])
    return log.select("id", T.feedback(F.col("feedback")).alias("feedback"), F.md5(F.coalesce("response", F.lit(""))).alias("response_md5"))


@query(f"""WITH n AS (SELECT chunk_id, 'Portal.pdf' AS source, 'portal,' || coalesce(topics, '') AS topics FROM {_LATEST} WHERE contains(lower(source), 'portal')), o AS (SELECT chunk_id, source, topics FROM {_LATEST} WHERE NOT contains(lower(source), 'portal'))
 SELECT source, count(*) AS chunks, count(*) FILTER (WHERE starts_with(topics, 'portal,')) AS tagged FROM (SELECT * FROM n UNION ALL SELECT * FROM o) GROUP BY source""")
def ingest_incremental(spark, sf_dir):
    """Named files ingested again under another source and with topics of their own: their chunks replace the stored ones by key."""
    stored = ingest.latest(table(spark, sf_dir, "chunks"), "chunk_id", "processed_date").select("chunk_id", "source", "topics")
    again = stored.where(F.lower("source").contains("portal")).withColumns({"source": F.lit("Portal.pdf"), "topics": F.concat(F.lit("portal,"), F.coalesce("topics", F.lit("")))})
    return ingest.upsert(stored, again, "chunk_id").groupBy("source").agg(F.count("*").alias("chunks"), F.count_if(F.startswith("topics", F.lit("portal,"))).alias("tagged"))


@query("SELECT role, coalesce(list_sort(list(source) FILTER (WHERE is_active = contains(source, 'Hindi'))), []) AS deactivated FROM source_files GROUP BY role")
def deactivated_toggled(spark, sf_dir):
    """Deactivated documents per role after each Hindi edition is toggled: out of the list if it is in, else into it."""
    listed = table(spark, sf_dir, "source_files").groupBy("role").agg(F.collect_list(F.when(~F.col("is_active"), F.col("source"))).alias("off"), F.collect_list(F.when(F.col("source").contains("Hindi"), F.col("source"))).alias("named"))  # a fixed table
    return listed.select("role", F.array_sort(T.toggled(F.col("off"), F.col("named"))).alias("deactivated"))


@query(f"""WITH l AS (SELECT lower(trim(query)) AS key, response AS answer, received_at, id FROM {_LAST} WHERE trim(coalesce(query, '')) <> '' AND response IS NOT NULL AND {_FED} = 'satisfied')
 SELECT key, arg_max(answer, (received_at, id)) AS answer FROM l GROUP BY key""")
def corrections_replaced(spark, sf_dir):
    """Stored answers by question, each replaced by the last that a user was satisfied with."""
    log = logs.once(table(spark, sf_dir, "query_log")).where(T.feedback(F.col("feedback")) == "satisfied").where("trim(coalesce(query, '')) <> '' and response is not null")
    rows = log.select(F.lower(F.trim("query")).alias("key"), F.col("response").alias("answer"), "received_at", "id")
    return rows.groupBy("key").agg(F.max_by("answer", F.struct("received_at", "id")).alias("answer"))


@query("SELECT source_db, count(DISTINCT chunk_id) AS chunks FROM chunks WHERE source_db <> 'vendor' GROUP BY source_db")
def collection_dropped(spark, sf_dir):
    """What is left when one store is dropped."""
    return table(spark, sf_dir, "chunks").where("source_db != 'vendor'").groupBy("source_db").agg(F.countDistinct("chunk_id").alias("chunks"))


@query("SELECT k.question_id, k.question FROM (SELECT DISTINCT question_id, question, source_file FROM kpi_test_questions) k WHERE k.source_file IN (SELECT source FROM source_files WHERE NOT is_active)")
def question_set(spark, sf_dir):
    """Questions about the documents of a named set."""
    named = table(spark, sf_dir, "source_files").where("not is_active").select(F.col("source").alias("source_file"))
    return table(spark, sf_dir, "kpi_test_questions").select("question_id", "question", "source_file").distinct().join(F.broadcast(named), "source_file", "left_semi").select("question_id", "question")


@query("SELECT file_path, md5(substring(arg_min(page_content, (page_num, page_id)), 1, 600)) AS head_md5 FROM scanned_pages WHERE page_num IS NOT NULL AND page_content IS NOT NULL GROUP BY file_path")
def first_page_snippet(spark, sf_dir):
    """The first 600 characters of the first page of each file."""
    pages = table(spark, sf_dir, "scanned_pages").where("page_num is not null and page_content is not null").select("file_path", "page_num", "page_id", F.substring("page_content", 1, 600).alias("head"))
    return pages.groupBy("file_path").agg(F.md5(F.min_by("head", F.struct("page_num", "page_id"))).alias("head_md5"))


@query("SELECT min(doc_id) AS doc_id, md5(substring(arg_min(squeezed, doc_id), 1, 800)) AS snippet_md5 FROM (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS squeezed FROM documents) WHERE length(squeezed) > 300 GROUP BY substring(squeezed, 1, 100)")
def snippets(spark, sf_dir):
    """A snippet of 800 characters of each text of more than 300, one of those that begin with the same 100."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"\s+", " ").alias("squeezed")).where("length(squeezed) > 300")
    one = docs.groupBy(F.substring("squeezed", 1, 100).alias("head")).agg(F.min_by(F.substring("squeezed", 1, 800), "doc_id").alias("snippet"), F.min("doc_id").alias("doc_id"))
    return one.select("doc_id", F.md5("snippet").alias("snippet_md5"))


_KEY = "lower(regexp_replace({}, '[^a-zA-Z0-9ऀ-ॿ]', '', 'g'))"


@query(f"""WITH k AS (SELECT question_id, source_file, substring({_KEY.format('ground_truth_context')}, 1, 80) AS snippet, length({_KEY.format('ground_truth_context')}) AS n FROM (SELECT DISTINCT question_id, source_file, ground_truth_context FROM kpi_test_questions)),
 c AS (SELECT source, chunk_index, {_KEY.format('page_content')} AS body FROM {_LATEST})
 SELECT question_id, CAST(min(chunk_index) AS INTEGER) AS first_chunk, count(*) AS found FROM k JOIN c ON c.source = k.source_file AND contains(c.body, k.snippet) WHERE n >= 30 GROUP BY question_id""")
def snippet_found(spark, sf_dir):
    """The first piece of its source that holds the first 80 letters and digits of a context; contexts of under 30 are not looked for."""
    asked = table(spark, sf_dir, "kpi_test_questions").select("question_id", F.col("source_file").alias("source"), T.snippet_key(F.col("ground_truth_context")).alias("key")).distinct()
    pieces = ingest.latest(table(spark, sf_dir, "chunks"), "chunk_id", "processed_date").select("source", "chunk_index", "page_content")
    return retrieve.holders(asked.where(F.length("key") >= 30), pieces, "question_id", "source", "page_content", "chunk_index").groupBy("question_id").agg(F.min("chunk_index").alias("first_chunk"), F.count("*").alias("found"))


@query("""WITH a AS (SELECT chunk_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS pos FROM (SELECT chunk_id, max(page_content) AS t FROM chunks GROUP BY chunk_id)),
 b AS (SELECT chunk_id, unnest(string_split_regex(t, '(?:।)\\s*')) AS hindi, generate_subscripts(string_split_regex(t, '(?:।)\\s*'), 1) - 1 AS pos FROM (SELECT chunk_id, max(original_hindi) AS t FROM chunks GROUP BY chunk_id))
 SELECT a.chunk_id, CAST(a.pos AS INTEGER) AS pos, md5(line) AS line_md5, md5(hindi) AS hindi_md5 FROM a JOIN b USING (chunk_id, pos)""")
def paired_by_position(spark, sf_dir):
    """Lines of a piece beside the sentences of its original, by position; what one side has more is left out."""
    one = table(spark, sf_dir, "chunks").groupBy("chunk_id").agg(F.max("page_content").alias("t"), F.max("original_hindi").alias("h")).where("t is not null and h is not null")
    lines, originals = F.split("t", "\n"), F.split("h", r"।\s*")
    paired = F.slice(F.arrays_zip(lines.alias("line"), originals.alias("hindi")), F.lit(1), F.least(F.size(lines), F.size(originals)))
    return one.select("chunk_id", F.posexplode(paired).alias("pos", "p")).select("chunk_id", "pos", F.md5("p.line").alias("line_md5"), F.md5("p.hindi").alias("hindi_md5"))


@query(f"""SELECT n AS text, count(DISTINCT question_id) AS questions, min(question_id) AS vector_of FROM (SELECT question_id, {sql_spelled('question')} AS n FROM kpi_test_questions) GROUP BY n""")
def query_vectors(spark, sf_dir):
    """Search texts that are a question itself: their vector is at hand, from the first question that is spelt so."""
    asked = table(spark, sf_dir, "kpi_test_questions").select("question_id", T.normalize_query(F.col("question")).alias("text"))
    return asked.groupBy("text").agg(F.countDistinct("question_id").alias("questions"), F.min("question_id").alias("vector_of"))


@query("SELECT CAST(row_number() OVER (ORDER BY length(source) DESC, source) AS INTEGER) AS by_length, CAST(row_number() OVER (ORDER BY source) AS INTEGER) AS by_name, source FROM (SELECT DISTINCT source FROM chunks)")
def sources_ordered(spark, sf_dir):
    """Sources from the longest name to the shortest, and by name: a row per source, which are few."""
    names = table(spark, sf_dir, "chunks").select("source").distinct()
    return names.select(F.row_number().over(Window.orderBy(F.desc(F.length("source")), "source")).alias("by_length"), F.row_number().over(Window.orderBy("source")).alias("by_name"), "source")


@query("""WITH p AS (SELECT source, page_id, max(page_num) AS page_num, max(page_content) AS t FROM scanned_pages GROUP BY source, page_id), s AS (SELECT *, len(regexp_extract_all(lower(t), 'tender|bid|निविदा|बोली')) AS score FROM p)
 SELECT source, count(DISTINCT page_num) AS pages, CAST(arg_min(page_num, (-score, page_num, page_id)) AS INTEGER) AS best_page FROM s WHERE page_num IS NOT NULL GROUP BY source""")
def best_page(spark, sf_dir):
    """Pages per source, and the one with the most words of the field; the first of equals."""
    pages = table(spark, sf_dir, "scanned_pages").groupBy("source", "page_id").agg(F.max("page_num").alias("page_num"), F.max("page_content").alias("t")).where("page_num is not null")
    score = F.regexp_count(F.lower("t"), F.lit("tender|bid|निविदा|बोली"))
    return pages.groupBy("source").agg(F.countDistinct("page_num").alias("pages"), F.min_by("page_num", F.struct(-F.coalesce(score, F.lit(0)), "page_num", "page_id")).alias("best_page"))


def _sql_route(c: str) -> str:
    english = _asks("english", "(?:इंग्लिश|अंग्रेजी|अंग्रेज़ी|अंगरेजी)\\s*(?:में|मे)")
    case = f"CASE WHEN {english} THEN 'en' WHEN {_asks('hinglish')} THEN 'hi-Latn' WHEN {_asks('hindi')} THEN 'hi' WHEN regexp_matches(x, '[ऀ-ॿ]') THEN 'hi' WHEN regexp_matches(x, '{_HINGLISH}') THEN 'hi-Latn' ELSE 'en' END"
    return case.replace("(x,", f"(lower(coalesce({c}, '')),")


_SECONDS = "CASE WHEN response_time_seconds >= 0 AND response_time_seconds < 3600 THEN response_time_seconds END"


@query(f"SELECT coalesce(role, 'none') AS role, coalesce(round(avg({_SECONDS}), 6), 0.0) AS mean_seconds, round(avg(CASE WHEN {_sql_route('query')} = {_sql_route('response')} THEN 100.0::DOUBLE ELSE 0.0 END), 6) AS conforming FROM {_LAST} WHERE query IS NOT NULL AND response IS NOT NULL GROUP BY 1")
def conformity(spark, sf_dir):
    """Mean response time, and the share of answers in the language that their question is routed to, per role."""
    log = logs.once(table(spark, sf_dir, "query_log")).where("query is not null and response is not null")
    same = F.when(T.route_language(F.col("query")) == T.route_language(F.col("response")), 100.0).otherwise(0.0)
    return log.groupBy(F.coalesce("role", F.lit("none")).alias("role")).agg(F.coalesce(F.round(F.avg(logs.response_seconds(F.col("response_time_seconds"))), 6), F.lit(0.0)).alias("mean_seconds"), F.round(F.avg(same), 6).alias("conforming"))


@query(f"""SELECT CASE WHEN grouping(route) = 1 THEN 'all' ELSE route END AS language, count(*) AS answers, round(avg(CASE WHEN s > 0 THEN s END), 6) AS mean_seconds, round(avg(length(response)), 6) AS mean_chars, round(avg(score) * 20, 6) AS accuracy FROM
 (SELECT {_sql_route('query')} AS route, {_SECONDS} AS s, response, CAST(coalesce(nullif(regexp_extract(response, '(^|[^0-9])([1-5])([^0-9]|$)', 2), ''), '3') AS INTEGER) AS score FROM {_LAST} WHERE query IS NOT NULL AND response IS NOT NULL) GROUP BY GROUPING SETS ((), (route))""")
def kpi_by_language(spark, sf_dir):
    """Means over all answers and per language of the question; times over those above 0 only."""
    log = logs.once(table(spark, sf_dir, "query_log")).where("query is not null and response is not null")
    s = logs.response_seconds(F.col("response_time_seconds"))
    score = F.coalesce(F.nullif(F.regexp_extract("response", r"(^|[^0-9])([1-5])([^0-9]|$)", 2), F.lit("")), F.lit("3")).cast("int")
    rows = log.select(T.route_language(F.col("query")).alias("route"), F.when(s > 0, s).alias("s"), F.length("response").alias("n"), score.alias("score"))
    sets = rows.rollup("route").agg(F.grouping("route").alias("_g"), F.count("*").alias("answers"), F.round(F.avg("s"), 6).alias("mean_seconds"), F.round(F.avg("n"), 6).alias("mean_chars"), F.round(F.avg("score") * 20, 6).alias("accuracy"))
    return sets.select(F.when(F.col("_g") == 1, "all").otherwise(F.col("route")).alias("language"), "answers", "mean_seconds", "mean_chars", "accuracy")


@query("SELECT regexp_extract(file_path, '^([^/]+/[^/]+)/', 1) AS folder, count(DISTINCT file_path) AS files FROM (SELECT file_path FROM chunks UNION ALL SELECT file_path FROM scanned_pages) GROUP BY 1")
def files_per_folder(spark, sf_dir):
    paths = table(spark, sf_dir, "chunks").select("file_path").union(table(spark, sf_dir, "scanned_pages").select("file_path")).distinct()
    return paths.groupBy(F.regexp_extract("file_path", "^([^/]+/[^/]+)/", 1).alias("folder")).agg(F.count("*").alias("files"))


_TERMS = f"(SELECT list(term ORDER BY n DESC, term) FROM (SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(query), '[a-zA-Zऀ-ॿ]{{3,}}')) AS term FROM {_LAST}) WHERE NOT list_contains({sql_list(lexicon.TERM_STOPWORDS)}, term) GROUP BY term ORDER BY n DESC, term LIMIT 5))"


@query(f"SELECT count(*) AS total_queries, coalesce(round(avg({_SECONDS}), 2), 0.0) AS avg_response_time, count(*) FILTER (WHERE {_FED} = 'satisfied') AS satisfied_count, count(*) FILTER (WHERE {_FED} = 'unsatisfied') AS unsatisfied_count, array_to_string({_TERMS}, ',') AS most_asked FROM {_LAST}")
def metrics_row(spark, sf_dir):
    """One row of measures with the words asked most."""
    log = logs.once(table(spark, sf_dir, "query_log"))
    terms = logs.top_terms(log, "query", 5).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "term"))), lambda x: x.term), ",").alias("most_asked"))  # five rows
    return logs.usage(log, []).select("total_queries", "avg_response_time", "satisfied_count", "unsatisfied_count").crossJoin(terms)


@query(f"""SELECT 'measure' AS section, name, CAST(v AS VARCHAR) AS value FROM (SELECT unnest(['total', 'satisfied', 'unsatisfied']) AS name, unnest([count(*), count(*) FILTER (WHERE {_FED} = 'satisfied'), count(*) FILTER (WHERE {_FED} = 'unsatisfied')]) AS v FROM {_LAST})
 UNION ALL SELECT 'term', term, CAST(n AS VARCHAR) FROM (SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(query), '[a-zA-Zऀ-ॿ]{{3,}}')) AS term FROM {_LAST}) WHERE NOT list_contains({sql_list(lexicon.TERM_STOPWORDS)}, term) GROUP BY term ORDER BY n DESC, term LIMIT 10)
 UNION ALL SELECT 'last', id, strftime(received_at, '%m-%d %H:%M') || ' ' || coalesce(substring(query, 1, 80) || CASE WHEN length(query) > 80 THEN '...' ELSE '' END, '') FROM (SELECT * FROM {_LAST} ORDER BY received_at DESC, id LIMIT 50)""")
def audit_report(spark, sf_dir):
    """The audit report as rows: measures, the ten words asked most, the last fifty entries."""
    log = logs.once(table(spark, sf_dir, "query_log"))
    u = logs.usage(log, [])
    measures = u.select(F.explode(F.create_map(*[x for n, c in (("total", "total_queries"), ("satisfied", "satisfied_count"), ("unsatisfied", "unsatisfied_count")) for x in (F.lit(n), F.col(c).cast("string"))])).alias("name", "value"))
    terms = logs.top_terms(log, "query", 10).select(F.col("term").alias("name"), F.col("n").cast("string").alias("value"))
    shown = F.coalesce(F.concat(F.substring("query", 1, 80), F.when(F.length("query") > 80, "...").otherwise("")), F.lit(""))
    last = log.orderBy(F.desc("received_at"), "id").limit(50).select(F.col("id").alias("name"), F.concat(F.date_format("received_at", "MM-dd HH:mm"), F.lit(" "), shown).alias("value"))
    parts = [df.select(F.lit(s).alias("section"), "name", "value") for s, df in (("measure", measures), ("term", terms), ("last", last))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_TURNS = "(SELECT session_id, id, max(received_at) AS seen FROM session_log WHERE session_id IS NOT NULL GROUP BY session_id, id)"


@query(f"""WITH g AS (SELECT session_id, seen, sum(fresh) OVER (PARTITION BY session_id ORDER BY seen, id ROWS UNBOUNDED PRECEDING) AS life FROM (SELECT *, CASE WHEN seen - lag(seen) OVER (PARTITION BY session_id ORDER BY seen, id) <= INTERVAL 3600 SECOND THEN 0 ELSE 1 END AS fresh FROM {_TURNS})),
 l AS (SELECT session_id, life, max(seen) AS last_at, count(*) AS turns FROM g GROUP BY session_id, life)
 SELECT session_id, count(*) AS lives, max(last_at) AS last_at, arg_max(turns, last_at) AS turns, max(last_at) >= (SELECT max(seen) FROM {_TURNS}) - INTERVAL 3600 SECOND AS alive FROM l GROUP BY session_id""")
def session_store(spark, sf_dir):
    """Sessions with a sliding expiry of an hour: how often each was opened, when it was last used, its turns since, and whether it is alive when the log ends."""
    turns = table(spark, sf_dir, "session_log").where("session_id is not null").groupBy("session_id", "id").agg(F.max("received_at").alias("at")).withColumn("at", F.col("at").cast("timestamp"))
    lives = turns.groupBy("session_id", F.session_window("at", "3600 seconds 1 microsecond").alias("w")).agg(F.max("at").alias("last_at"), F.count("*").alias("turns"))
    kept = lives.groupBy("session_id").agg(F.count("*").alias("lives"), F.max("last_at").alias("last_at"), F.max_by("turns", "last_at").alias("turns"))
    end = turns.agg(F.max("at").alias("_end"))
    alive = F.unix_micros("_end") - F.unix_micros("last_at") <= 3_600_000_000
    return kept.crossJoin(F.broadcast(end)).select("session_id", "lives", F.col("last_at").cast("timestamp_ntz").alias("last_at"), "turns", alive.alias("alive"))


@query("""WITH f AS (SELECT source_file, row_number() OVER (ORDER BY source_file) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT source_file FROM kpi_test_questions WHERE source_file IS NOT NULL)), p AS (SELECT k, source_file FROM f, unnest(range(5)) t(k) WHERE i = CAST(floor(k * n / 5) AS BIGINT))
 SELECT CAST(k AS INTEGER) AS place, p.source_file, min(q.question_id) AS question_id FROM p JOIN kpi_test_questions q ON q.source_file = p.source_file AND regexp_matches(q.question, '[ऀ-ॿ]') = (k % 2 = 1) GROUP BY k, p.source_file""")
def stratified_alternating(spark, sf_dir):
    """The first question of five evenly spaced files, by turns in Latin and in Devanagari script."""
    questions = table(spark, sf_dir, "kpi_test_questions").where("source_file is not null").select("source_file", "question_id", F.col("question").rlike("[ऀ-ॿ]").alias("indic"))
    named = questions.select("source_file").distinct()  # a row per source file, a fixed table
    placed = named.withColumn("i", F.row_number().over(Window.orderBy("source_file")) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    chosen = placed.select("source_file", "i", "n", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("place")).where(F.col("i") == F.floor(F.col("place") * F.col("n") / 5)).select("source_file", "place")
    return questions.join(F.broadcast(chosen), "source_file").where(F.col("indic") == (F.col("place") % 2 == 1)).groupBy("place", "source_file").agg(F.min("question_id").alias("question_id"))


@query("""SELECT p.page_id, '/docs/' || f.category || '/' || regexp_replace(p.source, '(?i)\\.(docx|txt)$', '.pdf') || '#page=' || p.page_num AS url FROM (SELECT page_id, max(source) AS source, max(page_num) AS page_num FROM scanned_pages GROUP BY page_id) p JOIN source_files f ON f.source = p.source""")
def citation_links(spark, sf_dir):
    """The address of each page in the document that it belongs to."""
    pages = table(spark, sf_dir, "scanned_pages").groupBy("page_id").agg(F.max("source").alias("source"), F.max("page_num").alias("page_num"))
    known = F.broadcast(table(spark, sf_dir, "source_files").select("source", "category"))  # a fixed table
    return pages.join(known, "source").select("page_id", F.concat(F.lit("/docs/"), "category", F.lit("/"), T.display_source(F.col("source")), F.lit("#page="), F.col("page_num").cast("string")).alias("url"))


@query(f"""WITH t AS (SELECT chunk_id, source, topics FROM {_LATEST}), s AS (SELECT DISTINCT source, list_filter(string_split_regex(lower(regexp_replace(source, '\\.[^.]+$', '')), '[-_. ]+'), lambda w: w IN ('tender', 'portal', 'audit', 'gfr', 'emd', 'vendor')) AS named FROM t)
 SELECT chunk_id, array_to_string(list_filter(l, lambda x, i: x <> '' AND list_position(l, x) = i), ',') AS topics FROM (SELECT chunk_id, list_concat(list_transform(string_split(coalesce(topics, ''), ','), lambda x: trim(x)), named) AS l FROM t JOIN s USING (source))""")
def topics_united(spark, sf_dir):
    """Stored topics of a chunk and those of its source's name, each once, in order."""
    chunks = ingest.latest(table(spark, sf_dir, "chunks"), "chunk_id", "processed_date").select("chunk_id", "source", "topics")
    stored = F.transform(F.split(F.coalesce("topics", F.lit("")), ","), F.trim)
    words = F.split(F.lower(F.regexp_replace("source", r"\.[^.]+$", "")), "[-_. ]+")
    named = F.filter(words, lambda w: w.isin("tender", "portal", "audit", "gfr", "emd", "vendor"))
    return chunks.select("chunk_id", F.array_join(F.filter(F.array_distinct(F.concat(stored, named)), lambda x: x != ""), ",").alias("topics"))


_SIGNS = (("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-"), ("…", "..."), ("•", "-"), ("₹", "Rs."))


def _sql_latin(c: str) -> str:
    for sign, plain in _SIGNS:
        c = f"replace({c}, '{sign}', '{plain.replace(chr(39), chr(39) * 2)}')"
    return c


@query(f"SELECT doc_id, md5({_sql_latin('text')}) AS latin_md5 FROM documents")
def latin_signs(spark, sf_dir):
    """Typographic signs of a text written in Latin-1, for printing."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(files.latin1(F.col("text"))).alias("latin_md5"))


@query("""WITH t AS (SELECT session_id, id, max(received_at) AS seen, max(query) AS query, max(response) AS response FROM session_log WHERE session_id IS NOT NULL GROUP BY session_id, id),
 m AS (SELECT session_id, seen, id, 0 AS turn, 'user: ' || query AS line FROM t WHERE query IS NOT NULL UNION ALL SELECT session_id, seen, id, 1, 'assistant: ' || response FROM t WHERE response IS NOT NULL)
 SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seen, id, turn) AS line_no, md5(line) AS line_md5 FROM m""")
def transcript_lines(spark, sf_dir):
    """Each conversation as numbered lines of speaker and text, however long it is."""
    turns = table(spark, sf_dir, "session_log").where("session_id is not null").groupBy("session_id", "id").agg(*[F.max(c).alias(c) for c in ("received_at", "query", "response")])
    said = [turns.select("session_id", "received_at", "id", F.lit(n).alias("turn"), F.lit(who).alias("speaker"), F.col(c).alias("text")).where("text is not null") for n, who, c in ((0, "user", "query"), (1, "assistant", "response"))]
    lines = files.transcript(said[0].unionByName(said[1]), "session_id", [F.col("received_at").asc(), F.col("id").asc(), F.col("turn").asc()], "speaker", "text")
    return lines.select("session_id", "line_no", F.md5("line").alias("line_md5"))
