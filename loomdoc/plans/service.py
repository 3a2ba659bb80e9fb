"""Logs, feedback, sessions, measures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomdoc import lexicon
from loomdoc.functions import text as T
from loomdoc.operators import logs
from loomdoc.operators.ranking import spread_positions
from loomdoc.plans.catalogue import query, sql_list
from loomdoc.session import table
from loomdoc.streaming import live

_ONCE = "(SELECT * FROM query_log QUALIFY row_number() OVER (PARTITION BY id ORDER BY received_at DESC, coalesce(response,'') DESC, coalesce(query,'') DESC) = 1)"
_FB = "CASE WHEN lower(regexp_replace(feedback, '^\\s+|\\s+$', '', 'g')) IN ('satisfied','unsatisfied') THEN lower(regexp_replace(feedback, '^\\s+|\\s+$', '', 'g')) ELSE 'neutral' END"
_USAGE = f"""count(*) AS total_queries, coalesce(round(avg(CASE WHEN response_time_seconds >= 0 AND response_time_seconds < 3600 THEN response_time_seconds END), 2), 0.0) AS avg_response_time,
 count(*) FILTER (WHERE {_FB} = 'satisfied') AS satisfied_count, count(*) FILTER (WHERE {_FB} = 'unsatisfied') AS unsatisfied_count, count(*) FILTER (WHERE {_FB} <> 'neutral') AS rated_count,
 CASE WHEN count(*) FILTER (WHERE {_FB} <> 'neutral') > 0 THEN round(count(*) FILTER (WHERE {_FB} = 'satisfied') * 100.0::DOUBLE / count(*) FILTER (WHERE {_FB} <> 'neutral'), 1) ELSE 100.0 END AS satisfaction_rate"""


def _log(spark, sf_dir):
    return logs.once(table(spark, sf_dir, "query_log"))


@query(f"SELECT {_USAGE} FROM {_ONCE}")
def metrics_summary(spark, sf_dir):
    return logs.usage(_log(spark, sf_dir), [])


@query(f"SELECT coalesce(role, 'all or none') AS role, grouping(role) AS level, {_USAGE} FROM {_ONCE} GROUP BY GROUPING SETS ((), (role))")
def kpi_summary(spark, sf_dir):
    log = _log(spark, sf_dir)
    every = logs.usage(log, []).select(F.lit("all or none").alias("role"), F.lit(1).cast("long").alias("level"), "*")
    return every.unionByName(logs.usage(log, ["role"]).withColumn("role", F.coalesce("role", F.lit("all or none"))).withColumn("level", F.lit(0).cast("long")))


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(query), '[a-zA-Zऀ-ॿ]{{3,}}')) AS term FROM {_ONCE}) WHERE NOT list_contains({sql_list(lexicon.TERM_STOPWORDS)}, term) GROUP BY term ORDER BY n DESC, term LIMIT 5")
def top_terms(spark, sf_dir):
    return logs.top_terms(_log(spark, sf_dir), "query", 5)


@query(f"SELECT id, received_at, query FROM {_ONCE} ORDER BY received_at DESC, id LIMIT 50")
def recent_log(spark, sf_dir):
    return _log(spark, sf_dir).orderBy(F.desc("received_at"), "id").limit(50).select("id", "received_at", "query")


@query(f"SELECT id, query, response FROM {_ONCE} WHERE {_FB} = 'unsatisfied'")
def disliked_log(spark, sf_dir):
    return _log(spark, sf_dir).where(T.feedback(F.col("feedback")) == "unsatisfied").select("id", "query", "response")


@query(f"SELECT id, strftime(received_at, '%m-%d %H:%M') AS at, substring(query, 1, 80) || CASE WHEN length(query) > 80 THEN '...' ELSE '' END AS shown FROM {_ONCE} WHERE role = 'vendor' AND contains(lower(query), 'bid')")
def log_filter(spark, sf_dir):
    shown = F.concat(F.substring("query", 1, 80), F.when(F.length("query") > 80, "...").otherwise(""))
    return _log(spark, sf_dir).where((F.col("role") == "vendor") & F.lower("query").contains("bid")).select("id", F.date_format("received_at", "MM-dd HH:mm").alias("at"), shown.alias("shown"))


@query(f"SELECT 'vendor' AS source_db, id AS chunk_id, 'learned,faq' AS topics, 'Question: ' || query || chr(10) || 'Answer: ' || response AS page_content FROM {_ONCE} WHERE {_FB} = 'satisfied' AND role IS DISTINCT FROM 'government_officer' AND query IS NOT NULL AND response IS NOT NULL UNION ALL SELECT 'govt', id, 'learned,faq', 'Question: ' || query || chr(10) || 'Answer: ' || response FROM {_ONCE} WHERE {_FB} = 'satisfied' AND role = 'government_officer' AND query IS NOT NULL AND response IS NOT NULL")
def learned_answers(spark, sf_dir):
    liked = _log(spark, sf_dir).where((T.feedback(F.col("feedback")) == "satisfied") & F.col("query").isNotNull() & F.col("response").isNotNull())
    store = F.when(F.col("role") == "government_officer", "govt").otherwise("vendor")
    return liked.select(store.alias("source_db"), F.col("id").alias("chunk_id"), F.lit("learned,faq").alias("topics"), F.concat(F.lit("Question: "), "query", F.lit("\nAnswer: "), "response").alias("page_content"))


@query("SELECT session_id, id, CAST(back AS INTEGER) AS back FROM (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY received_at DESC, id) AS back FROM (SELECT session_id, id, max(received_at) AS received_at FROM session_log WHERE session_id IS NOT NULL GROUP BY ALL)) WHERE back <= 5")
def history_last_n(spark, sf_dir):
    rows = table(spark, sf_dir, "session_log").where("session_id is not null").groupBy("session_id", "id").agg(F.max("received_at").alias("received_at"))
    return logs.last_turns(rows, "session_id", [F.desc("received_at"), F.col("id").asc()], 5).select("session_id", "id", "back")


@query("WITH t AS (SELECT session_id, id, max(received_at) AS received_at, max(query) AS query, max(response) AS response FROM session_log WHERE session_id IS NOT NULL GROUP BY ALL), p AS (SELECT session_id, id, query, lag(query) OVER w AS asked, lag(response) OVER w AS told FROM t WINDOW w AS (PARTITION BY session_id ORDER BY received_at, id)) SELECT session_id, id, asked || ' ' || query AS merged FROM p WHERE asked IS NOT NULL AND query IS NOT NULL AND (told IS NULL OR told = '')")
def clarify_merge(spark, sf_dir):
    turns = table(spark, sf_dir, "session_log").where("session_id is not null").groupBy("session_id", "id").agg(*[F.max(c).alias(c) for c in ("received_at", "query", "response")])
    placed = spread_positions(turns, ["session_id"], [F.col("received_at").asc(), F.col("id").asc()])
    earlier = placed.select("session_id", (F.col("position") + 1).alias("position"), F.col("query").alias("asked"), F.col("response").alias("told"))
    before = placed.join(earlier, ["session_id", "position"])
    return before.where("asked is not null and query is not null and (told is null or told = '')").select("session_id", "id", F.concat("asked", F.lit(" "), "query").alias("merged"))


@query("SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS events FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def sessionize(spark, sf_dir):
    return logs.sessionize(table(spark, sf_dir, "events"), "user_id", "ts").select("user_id", "session_start", "session_end", "events")


@query("SELECT event_type, round(sum(value), 2) AS total, round(sum(value) / sum(sum(value)) OVER () * 100, 4) AS share FROM events GROUP BY event_type")
def stage_share(spark, sf_dir):
    by = table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum("value").alias("t"))
    return by.select("event_type", F.round("t", 2).alias("total"), F.round(F.col("t") / F.sum("t").over(Window.partitionBy()) * 100, 4).alias("share"))


@query("WITH f AS (SELECT source_file, row_number() OVER (ORDER BY source_file) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT source_file FROM kpi_test_questions WHERE source_file IS NOT NULL)), p AS (SELECT source_file, i FROM f WHERE i IN (SELECT CAST(floor(k * n / 5) AS BIGINT) FROM f, unnest(range(5)) t(k))) SELECT p.source_file, min(question_id) AS question_id FROM p JOIN kpi_test_questions k ON k.source_file = p.source_file GROUP BY p.source_file")
def stratified_sample(spark, sf_dir):
    questions = table(spark, sf_dir, "kpi_test_questions").where("source_file is not null")
    files = questions.select("source_file").distinct()  # a row per source file, a fixed table
    ranked = files.withColumn("i", F.row_number().over(Window.orderBy("source_file")) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    chosen = ranked.where(F.array_contains(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.floor(k * F.col("n") / 5).cast("int")), F.col("i"))).select("source_file")
    return questions.join(F.broadcast(chosen), "source_file").groupBy("source_file").agg(F.min("question_id").alias("question_id"))


@query("SELECT md5(substring(squeezed, 1, 100)) AS head_md5, min(doc_id) AS doc_id, count(*) AS alike FROM (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS squeezed FROM documents) WHERE length(squeezed) > 300 GROUP BY 1")
def snippet_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"\s+", " ").alias("squeezed")).where("length(squeezed) > 300")
    return docs.groupBy(F.md5(F.substring("squeezed", 1, 100)).alias("head_md5")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("alike"))


_GREET = r"^(hi|hello|hey|namaste|नमस्ते|namaskar)[!. ]*$"
_DOMAIN = "tender|bid|emd|gfr|rule|vendor|portal|निविदा|बोली|क्रय|नियम|कार्यालय"


@query(f"SELECT id, CASE WHEN q IS NULL THEN 'blank' WHEN regexp_matches(q, 'password|पासवर्ड') THEN 'blocked' WHEN length(q) <= 4 AND NOT regexp_matches(q, '{_DOMAIN}') THEN 'short' WHEN regexp_matches(q, '{_GREET}') THEN 'greeting' WHEN length(q) <= 30 AND NOT regexp_matches(q, '{_DOMAIN}') THEN 'vague' ELSE 'pass' END AS intent FROM (SELECT id, nullif(lower(regexp_replace(query, '^\\s+|\\s+$', '', 'g')), '') AS q FROM {_ONCE})")
def intent_guard(spark, sf_dir):
    q = F.nullif(F.lower(T.strip(F.col("query"))), F.lit(""))
    intent = (
        F.when(F.col("q").isNull(), "blank").when(F.col("q").rlike("password|पासवर्ड"), "blocked").when((F.length("q") <= 4) & ~F.col("q").rlike(_DOMAIN), "short")
        .when(F.col("q").rlike(_GREET), "greeting").when((F.length("q") <= 30) & ~F.col("q").rlike(_DOMAIN), "vague").otherwise("pass")
    )
    return _log(spark, sf_dir).select("id", q.alias("q")).select("id", intent.alias("intent"))


@query(f"SELECT l.id, min(p.place) AS place FROM {_ONCE} l JOIN (VALUES (1, 'refund|वापसी'), (2, 'password|पासवर्ड'), (3, '^how many')) p(place, pattern) ON regexp_matches(lower(l.query), p.pattern) GROUP BY l.id")
def blacklist_match(spark, sf_dir):
    patterns = spark.createDataFrame([(1, "refund|वापसी"), (2, "password|पासवर्ड"), (3, "^how many")], "place int, pattern string")
    return _log(spark, sf_dir).select("id", F.lower("query").alias("q")).join(F.broadcast(patterns), F.expr("q rlike pattern")).groupBy("id").agg(F.min("place").alias("place"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def live_metrics(spark, sf_dir):
    return live.metrics(spark, sf_dir)


@query("SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended, count(*) AS events FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)) GROUP BY user_id, s")
def live_sessions(spark, sf_dir):
    return live.sessions(spark, sf_dir)
