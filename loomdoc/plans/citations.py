"""Citations, contexts of hits, history blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomdoc.functions import text as T
from loomdoc.operators import ingest
from loomdoc.plans.catalogue import query
from loomdoc.session import table

_LATEST = "(SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY processed_date DESC NULLS LAST) = 1)"
_RULE = r"(?:rule|ru1e|clause|section|chapter|नियम|खंड|अध्याय) ?(\d+)"
_STOP = "('with','from','guide','notes','handbook','register','digest','manual','hindi')"


@query("""WITH l AS (SELECT page_id, unnest(string_split(page_content, chr(10))) AS line, generate_subscripts(string_split(page_content, chr(10)), 1) AS i FROM (SELECT DISTINCT page_id, page_content FROM scanned_pages)),
 h AS (SELECT page_id, i FROM l WHERE regexp_matches(lower(line), 'tender|निविदा'))
 SELECT DISTINCT l.page_id, CAST(l.i AS INTEGER) AS line_no FROM l JOIN h ON l.page_id = h.page_id AND l.i BETWEEN h.i - 2 AND h.i + 4""")
def line_context(spark, sf_dir):
    pages = table(spark, sf_dir, "scanned_pages").select("page_id", "page_content").dropDuplicates()
    hits = F.transform(F.split("page_content", "\n"), lambda x, i: F.when(F.lower(x).rlike("tender|निविदा"), F.sequence(i - 1, i + 5)))
    near = F.filter(F.array_distinct(F.flatten(F.array_compact(hits))), lambda n: (n >= 1) & (n <= F.size(F.split("page_content", "\n"))))
    return pages.select("page_id", F.explode(near).alias("line_no"))


@query(f"""WITH r AS (SELECT source_db, file_path, chunk_index, chunk_id, unnest(regexp_extract_all(lower(page_content), '{_RULE}', 1)) AS rule, generate_subscripts(regexp_extract_all(lower(page_content), '{_RULE}', 1), 1) AS spot FROM {_LATEST}),
 f AS (SELECT source_db, file_path, rule, min(struct_pack(a := chunk_index, b := chunk_id, c := spot)) AS first FROM r GROUP BY ALL)
 SELECT source_db, file_path, rule, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY source_db, file_path ORDER BY first) AS place FROM f) WHERE place <= 5""")
def rule_harvest(spark, sf_dir):
    chunks = ingest.latest(table(spark, sf_dir, "chunks"), "chunk_id", "processed_date")
    found = F.posexplode(F.regexp_extract_all(F.lower("page_content"), F.lit(_RULE), F.lit(1))).alias("at", "rule")
    first = chunks.select("source_db", "file_path", "chunk_index", "chunk_id", found).groupBy("source_db", "file_path", "rule").agg(F.min(F.struct("chunk_index", "chunk_id", "at")).alias("first"))
    rank = F.row_number().over(_by_file())
    return first.withColumn("place", rank).where("place <= 5").select("source_db", "file_path", "rule", "place")


def _by_file():
    from pyspark.sql import Window

    return Window.partitionBy("source_db", "file_path").orderBy("first")


@query("""SELECT id, '/docs/' || CASE WHEN role = 'government_officer' THEN 'govt' ELSE 'vendor' END || '/' || coalesce(session_id, 'none') || '.pdf#page=' || pages[1] AS url, CASE len(pages) WHEN 1 THEN 'Reference' ELSE array_to_string(list_slice(pages, 1, 3), ', ') END AS shown
 FROM (SELECT DISTINCT id, role, session_id, list_transform(list_sort(list_distinct(list_transform(regexp_extract_all(response, '(?:Page|page|पृष्ठ) (\\d+)', 1), lambda p: p::INT))), lambda p: p::VARCHAR) AS pages FROM query_log) WHERE len(pages) > 0""")
def citation_refs(spark, sf_dir):
    log = table(spark, sf_dir, "query_log").select("id", "role", "session_id", T.pages(F.col("response")).cast("array<string>").alias("pages")).dropDuplicates().where("size(pages) > 0")
    store = F.when(F.col("role") == "government_officer", "govt").otherwise("vendor")
    url = F.concat(F.lit("/docs/"), store, F.lit("/"), F.coalesce("session_id", F.lit("none")), F.lit(".pdf#page="), F.col("pages")[0])
    return log.select("id", url.alias("url"), F.when(F.size("pages") == 1, "Reference").otherwise(F.array_join(F.slice("pages", 1, 3), ", ")).alias("shown"))


@query(f"SELECT source, array_to_string(CASE WHEN len(k) > 0 THEN k ELSE w[1:3] END, ' ') AS keywords, chunks FROM (SELECT source, w, list_filter(w, lambda x: length(x) > 3 AND x NOT IN {_STOP}) AS k, chunks FROM (SELECT source, string_split_regex(lower(regexp_replace(source, '\\.[^.]+$', '')), '[-_. ]+') AS w, count(*) AS chunks FROM chunks GROUP BY source))")
def source_keywords(spark, sf_dir):
    every = F.split(F.lower(F.regexp_replace("source", r"\.[^.]+$", "")), "[-_. ]+")
    words = F.filter(every, lambda w: (F.length(w) > 3) & ~w.isin(*[x.strip("'") for x in _STOP.strip("()").split(",")]))
    return table(spark, sf_dir, "chunks").groupBy("source").agg(F.count("*").alias("chunks")).select("source", F.array_join(F.when(F.size(words) > 0, words).otherwise(F.slice(every, 1, 3)), " ").alias("keywords"), "chunks")


@query("""WITH t AS (SELECT session_id, id, max(received_at) AS received_at, max(query) AS query, max(response) AS response FROM session_log WHERE session_id IS NOT NULL GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY received_at DESC, id) AS back FROM t)
 SELECT session_id, string_agg(coalesce(query, '') || ' -> ' || substring(coalesce(response, ''), 1, 400) || CASE WHEN length(response) > 400 THEN '...' ELSE '' END, chr(10) ORDER BY back DESC) AS block FROM r WHERE back <= 3 GROUP BY session_id""")
def history_block(spark, sf_dir):
    from loomdoc.operators import logs

    turns = table(spark, sf_dir, "session_log").where("session_id is not null").groupBy("session_id", "id").agg(*[F.max(c).alias(c) for c in ("received_at", "query", "response")])
    last = logs.last_turns(turns, "session_id", [F.desc("received_at"), F.col("id").asc()], 3)
    said = F.concat(F.coalesce("query", F.lit("")), F.lit(" -> "), F.substring(F.coalesce("response", F.lit("")), 1, 400), F.when(F.length("response") > 400, "...").otherwise(""))
    return last.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("o"), said.alias("s")))), lambda x: x.s), "\n").alias("block"))
