"""Text transforms over the corpus tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomdoc import lexicon
from loomdoc.functions import text as T
from loomdoc.operators import ingest
from loomdoc.plans.catalogue import query, sql_list
from loomdoc.session import table

_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(13)||chr(10), chr(10)), chr(13), chr(10)), '[ \t]+', ' ', 'g'), '([ऀ-ॿ])[ \t\n]+([ऀ-ॿ])', '\1\2', 'g'), '[^a-zA-Z0-9_ \t\n.,\-/₹()%ऀ-ॿ]', '', 'g'), '\n[ \t\n]*\n', chr(10)||chr(10), 'g'), '^[ \t\n]+|[ \t\n]+$', '', 'g')"
_TOKENS = "list_filter(list_distinct(regexp_extract_all(lower(coalesce({c},'')), '[a-z0-9_ऀ-ॿ]+')), lambda w: NOT list_contains(" + sql_list(lexicon.STOPWORDS) + ", w))"


def sql_tokens(c: str) -> str:
    return _TOKENS.replace("{c}", c)


def sql_topics(c: str) -> str:
    cases = ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(coalesce({c},'')), '{w}')" for w in words) + f" THEN '{t}' END" for t, words in lexicon.TOPICS.items())
    return f"list_filter([{cases}], lambda t: t IS NOT NULL)"


def sql_rules(c: str) -> str:
    cases = ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(coalesce({c},'')), '{w}')" for w in words) + f" THEN '{r}' END" for r, words in lexicon.RULE_TERMS.items())
    named = f"list_filter(regexp_extract_all(lower(coalesce({c},'')), '(?:^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])(?:rule|clause|section|नियम|खंड)\\s*(\\p{{Nd}}[\\p{{L}}\\p{{M}}\\p{{N}}_]*)', 1), lambda n: regexp_full_match(n, '\\p{{Nd}}+'))"
    return f"list_concat({named}, list_filter([{cases}], lambda t: t IS NOT NULL))"


@query(f"SELECT doc_id, length({_CLEAN}) AS clean_chars, md5({_CLEAN}) AS clean_md5 FROM documents")
def clean_text(spark, sf_dir):
    x = T.clean_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", x.alias("x")).select("doc_id", F.length("x").alias("clean_chars"), F.md5("x").alias("clean_md5"))


@query("""WITH l AS (SELECT page_id, unnest(string_split(page_content, chr(10))) AS line, generate_subscripts(string_split(page_content, chr(10)), 1) AS i FROM (SELECT DISTINCT page_id, page_content FROM scanned_pages)),
 b AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS bare FROM l),
 z AS (SELECT page_id, i, row_number() OVER (PARTITION BY page_id ORDER BY i) AS up, row_number() OVER (PARTITION BY page_id ORDER BY i DESC) AS down, bare FROM b WHERE bare <> '')
 SELECT page_id, count(*) AS lines, count(*) FILTER (WHERE (up <= 3 OR down <= 3) AND regexp_matches(bare, '^(?i)(\\d+|page\\s+\\d+(\\s+of\\s+\\d+)?)$')) AS dropped FROM z GROUP BY page_id""")
def strip_header_footer(spark, sf_dir):
    pages = table(spark, sf_dir, "scanned_pages").select("page_id", "page_content").dropDuplicates()
    bare = F.filter(F.transform(F.split("page_content", "\n"), T.strip), lambda x: x != "")
    noise = lambda x, i: ((i < 3) | (i >= F.size("b") - 3)) & x.rlike(r"^(?i)(\d+|page\s+\d+(\s+of\s+\d+)?)$")
    return pages.select("page_id", bare.alias("b")).where("size(b) > 0").select("page_id", F.size("b").cast("long").alias("lines"), F.size(F.filter("b", noise)).cast("long").alias("dropped"))


@query(r"""WITH l AS (SELECT page_id, unnest(string_split(t, chr(10))) AS raw, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM (SELECT page_id, replace(coalesce(max(page_content), ''), chr(13), '') AS t FROM scanned_pages GROUP BY page_id)),
 s AS (SELECT page_id, i, trim(raw, ' ') AS x FROM l), p AS (SELECT *, lag(x) OVER w AS before FROM s WINDOW w AS (PARTITION BY page_id ORDER BY i)),
 g AS (SELECT page_id, i, x, sum(CASE WHEN x = '' OR coalesce(before, '') = '' OR regexp_matches(x, '^(?:[-*•▪●]|\d+[.)]|\(?[a-z]\)|Rule |नियम )') OR regexp_matches(before, '[.!?।:]$') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS para FROM p),
 m AS (SELECT page_id, para, string_agg(x, ' ' ORDER BY i) AS paragraph FROM g WHERE x <> '' GROUP BY page_id, para)
 SELECT page_id, coalesce(list(paragraph ORDER BY para) FILTER (WHERE paragraph IS NOT NULL), []) AS paragraphs FROM (SELECT DISTINCT page_id FROM scanned_pages) LEFT JOIN m USING (page_id) GROUP BY page_id""")
def merge_layout_lines(spark, sf_dir):
    return ingest.merged_lines(table(spark, sf_dir, "scanned_pages").dropDuplicates(["page_id"]), "page_id", "page_content")


@query(f"""WITH d AS (SELECT doc_id, source, text, greatest(1, CAST(ceil((length(text) - {lexicon.CHUNK_OVERLAP}) / {lexicon.CHUNK_SIZE - lexicon.CHUNK_OVERLAP}.0) AS BIGINT)) AS total FROM documents WHERE text IS NOT NULL AND text <> '')
 SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(total AS INTEGER) AS total_chunks, printf('%s_%d_chunk_%04d', source, doc_id, i) AS chunk_key, md5(substring(text, CAST(i * {lexicon.CHUNK_SIZE - lexicon.CHUNK_OVERLAP} + 1 AS BIGINT), {lexicon.CHUNK_SIZE})) AS chunk_md5
 FROM d, unnest(range(total)) AS t(i)""")
def chunk_stride(spark, sf_dir):
    return ingest.stride_chunks(table(spark, sf_dir, "documents"), "doc_id", "source", "text").select("doc_id", "chunk_index", "total_chunks", "chunk_key", F.md5("chunk").alias("chunk_md5"))


@query()
def chunk_recursive(spark, sf_dir):
    return ingest.recursive_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT chunk_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', 1 + (instr('0123456789abcdef', h[17]) - 1) % 4, 1) || h[18:20] || '-' || h[21:32] AS point_id FROM (SELECT DISTINCT chunk_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(chunk_id)) AS h FROM chunks)")
def point_key(spark, sf_dir):
    return table(spark, sf_dir, "chunks").select("chunk_id").distinct().select("chunk_id", T.point_key(F.col("chunk_id")).alias("point_id"))


@query("""SELECT doc_id, round(len(regexp_extract_all(text, '[ऀ-ॿ]')) / nullif(len(regexp_extract_all(text, '[a-zA-Zऀ-ॿ]')), 0)::DOUBLE, 6) AS share,
 coalesce(len(regexp_extract_all(text, '[ऀ-ॿ]')) / nullif(len(regexp_extract_all(text, '[a-zA-Zऀ-ॿ]')), 0)::DOUBLE >= 0.15, false) OR contains(lower(source), 'hindi') AS hindi FROM documents""")
def script_density(spark, sf_dir):
    share = T.devanagari_share(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(share, 6).alias("share"), (F.coalesce(share >= 0.15, F.lit(False)) | F.lower("source").contains("hindi")).alias("hindi"))


def _asks(language: str, more: str = "") -> str:
    before, after = r"(?:^|[^\p{L}\p{M}\p{N}_])", r"(?:$|[^\p{L}\p{M}\p{N}_])"
    forms = (
        rf"{before}in\s+{language}{after}", rf"{before}{language}\s*(?:me|mein|main|mai|maiin){after}", rf"{before}{language}\s*(?:please|plz|only){after}",
        rf"{before}(?:reply|answer|respond|write|tell|explain)\s+(?:in\s+)?{language}{after}", rf"{language}\s*(?:में|मे)", *([more] if more else []),
    )
    return "(" + " OR ".join(f"regexp_matches(x, '{f}')" for f in forms) + ")"


_HINGLISH = r"(?:^|[^\p{L}\p{M}\p{N}_])(" + "|".join(lexicon.HINGLISH) + r")(?:$|[^\p{L}\p{M}\p{N}_])"


@query(f"""SELECT id, CASE WHEN {_asks('english', '(?:इंग्लिश|अंग्रेजी|अंग्रेज़ी|अंगरेजी)\\s*(?:में|मे)')} THEN 'en' WHEN {_asks('hinglish')} THEN 'hi-Latn' WHEN {_asks('hindi')} THEN 'hi'
 WHEN regexp_matches(x, '[ऀ-ॿ]') THEN 'hi' WHEN regexp_matches(x, '{_HINGLISH}') THEN 'hi-Latn' ELSE 'en' END AS route FROM (SELECT id, lower(coalesce(query,'')) AS x FROM query_log)""")
def lang_route(spark, sf_dir):
    return table(spark, sf_dir, "query_log").select("id", T.route_language(F.col("query")).alias("route"))


def sql_spelled(c: str) -> str:
    for wrong, right in lexicon.SPELLINGS:
        c = f"regexp_replace({c}, '(?i){wrong}', '{right}', 'g')"
    return c


@query(f"SELECT question_id, {sql_spelled('question')} AS normalized FROM kpi_test_questions")
def normalize_query(spark, sf_dir):
    return table(spark, sf_dir, "kpi_test_questions").select("question_id", T.normalize_query(F.col("question")).alias("normalized"))


@query(f"SELECT DISTINCT chunk_id, array_to_string({sql_topics('source')}, ',') AS source_topics, array_to_string({sql_topics('page_content')}, ',') AS text_topics FROM chunks")
def topic_infer(spark, sf_dir):
    return table(spark, sf_dir, "chunks").select("chunk_id", F.array_join(T.topics(F.col("source")), ",").alias("source_topics"), F.array_join(T.topics(F.col("page_content")), ",").alias("text_topics")).distinct()


@query("SELECT chunk_id, rule, count(*) AS mentions FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(coalesce(page_content,'')), '(?:rule|ru1e|clause|section|chapter|नियम|खंड|अध्याय) ?(\\d+)', 1)) AS rule FROM (SELECT DISTINCT chunk_id, page_content FROM chunks)) GROUP BY ALL")
def rule_extract(spark, sf_dir):
    pattern = F.lit(r"(?:rule|ru1e|clause|section|chapter|नियम|खंड|अध्याय) ?(\d+)")
    chunks = table(spark, sf_dir, "chunks").select("chunk_id", "page_content").dropDuplicates()
    return chunks.select("chunk_id", F.explode(F.regexp_extract_all(F.lower("page_content"), pattern, F.lit(1))).alias("rule")).groupBy("chunk_id", "rule").agg(F.count("*").alias("mentions"))


_CITED = T.CITATION.replace("'", "''")


@query(f"""SELECT id, citation, CAST(min(place) AS INTEGER) AS place FROM (SELECT id, place, regexp_replace(regexp_replace(citation, '\\s+', ' ', 'g'), '(?i)^ru1e', 'Rule') AS citation FROM (SELECT id, unnest(f) AS citation, generate_subscripts(f, 1) AS place FROM (SELECT id, list_filter(regexp_extract_all(response, '(?i){_CITED}', 1), lambda x: NOT regexp_matches(x, '(?i)\\s[a-z][\\p{{L}}\\p{{M}}\\p{{N}}_]+$')) AS f FROM (SELECT id, max(response) AS response FROM query_log GROUP BY id)))) GROUP BY id, citation""")
def rule_citations(spark, sf_dir):
    """Rules, clauses, sections and chapters that an answer cites, as they are written, with the place of the first."""
    log = table(spark, sf_dir, "query_log").groupBy("id").agg(F.max("response").alias("response"))
    found = F.regexp_extract_all("response", F.lit("(?i)" + T.CITATION), F.lit(1))
    whole = F.filter(found, lambda x: ~x.rlike(r"(?i)\s[a-z][\p{L}\p{M}\p{N}_]+$"))
    one = log.select("id", F.posexplode(whole).alias("at", "c")).withColumn("citation", F.regexp_replace(F.regexp_replace("c", r"\s+", " "), "(?i)^ru1e", "Rule"))
    return one.groupBy("id", "citation").agg((F.min("at") + 1).cast("int").alias("place"))


@query(f"""SELECT id, len(list_filter(string_split_regex(query, '\\s+'), lambda w: w <> '')) <= 8 OR {' OR '.join(f"contains(lower(query), '{w}')" for w in lexicon.VAGUE)} AS follows FROM (SELECT id, max(query) AS query FROM query_log GROUP BY id) WHERE query IS NOT NULL""")
def follow_up(spark, sf_dir):
    """Whether a question needs the turn before it: it is short, or vague."""
    log = table(spark, sf_dir, "query_log").groupBy("id").agg(F.max("query").alias("query")).where("query is not null")
    return log.select("id", T.is_follow_up(F.col("query")).alias("follows"))


@query("SELECT page_id, md5('--- Page ' || page_num || coalesce(' (' || nullif(ocr, 'native') || ')', '') || ' ---' || chr(10) || page_content) AS framed_md5, page_num AS page FROM (SELECT page_id, max(page_num) AS page_num, max(ocr) AS ocr, max(page_content) AS page_content FROM scanned_pages GROUP BY page_id)")
def page_frames(spark, sf_dir):
    """Each page under its marker, with the label of what read it, and the number that is read back from the marker."""
    pages = table(spark, sf_dir, "scanned_pages").groupBy("page_id").agg(*[F.max(c).alias(c) for c in ("page_num", "ocr", "page_content")])
    label = F.coalesce(F.concat(F.lit(" ("), F.nullif("ocr", F.lit("native")), F.lit(")")), F.lit(""))
    framed = F.concat(F.lit("--- Page "), F.col("page_num").cast("string"), label, F.lit(" ---\n"), "page_content")
    return pages.select("page_id", framed.alias("framed")).select("page_id", F.md5("framed").alias("framed_md5"), T.marked_pages(F.col("framed"))[0].alias("page"))


@query(f"SELECT question_id, array_to_string(list_sort(list_distinct({sql_rules('question')})), ',') AS rules, array_to_string(list_sort(list_distinct(list_transform(list_filter({sql_rules('question')}, lambda r: regexp_matches(r, '^1\\d\\d$')), lambda r: '4' || r[2:3]))), ',') AS misread FROM kpi_test_questions")
def query_rules(spark, sf_dir):
    rules = T.query_rules(F.col("question"))
    return table(spark, sf_dir, "kpi_test_questions").select("question_id", F.array_join(F.array_sort(rules), ",").alias("rules"), F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.transform(rules, T.misread_rule)))), ",").alias("misread"))


@query("SELECT id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(response,''), '(?:Page|page|पृष्ठ) (\\d+)', 1), lambda p: p::INT))), ',') AS pages FROM query_log")
def page_extract(spark, sf_dir):
    return table(spark, sf_dir, "query_log").select("id", F.array_join(T.pages(F.col("response")).cast("array<string>"), ",").alias("pages"))


def _last(part: str, h: str = "h") -> str:
    n = len(part.replace("\\n", "\n"))
    back = "".join(reversed(part))
    lit = " || ".join("chr(10)" if x == "\n" else f"'{x}'" for x in back)
    return f"(CASE WHEN instr(reverse({h}), {lit}) = 0 THEN -1 ELSE length({h}) - instr(reverse({h}), {lit}) - {n} + 1 END)"


_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def sql_cut(c: str, h: str = "h") -> str:
    """A text cut at a boundary; ``h`` is its head."""
    low = lexicon.CHUNK_CHARS - 500
    best = "greatest(" + ", ".join(f"CASE WHEN {_last(e, h)} > {low} THEN {_last(e, h)} + {len(e) - 1} ELSE -1 END" for e in lexicon.SENTENCE_ENDS) + ")"
    paragraph = _last(chr(10) * 2, h)
    return f"CASE WHEN length({c}) <= {lexicon.CHUNK_CHARS} THEN {c} WHEN {paragraph} > {low} THEN {_TRIM.format(f'substring({h}, 1, {paragraph})')} WHEN {best} <> -1 THEN {_TRIM.format(f'substring({h}, 1, {best} + 1)')} ELSE {_TRIM.format(h)} END"


@query(f"SELECT doc_id, length(t) AS chars, md5(t) AS cut_md5 FROM (SELECT doc_id, {sql_cut('text')} AS t FROM (SELECT doc_id, text, substring(text, 1, {lexicon.CHUNK_CHARS}) AS h FROM documents))")
def truncate_boundary(spark, sf_dir):
    x = T.truncate(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", x.alias("t")).select("doc_id", F.length("t").alias("chars"), F.md5("t").alias("cut_md5"))


@query(f"SELECT question_id, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 OR len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE END, 6) AS jaccard FROM (SELECT question_id, {sql_tokens('question')} AS a, {sql_tokens('ground_truth_context')} AS b FROM kpi_test_questions)")
def jaccard_pairs(spark, sf_dir):
    return table(spark, sf_dir, "kpi_test_questions").select("question_id", F.round(T.jaccard(T.tokens(F.col("question")), T.tokens(F.col("ground_truth_context"))), 6).alias("jaccard"))


@query("SELECT doc_id, CAST(floor(len(string_split_regex(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+')) * 1.3) AS INTEGER) AS tokens FROM documents WHERE regexp_matches(text, '\\S')")
def token_estimate(spark, sf_dir):
    words = F.size(F.split(T.strip(F.col("text")), r"\s+"))
    return table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\S")).select("doc_id", F.floor(words * 1.3).cast("int").alias("tokens"))


@query("SELECT page_id, translate(page_content, '०१२३४५६७८९', '0123456789') AS latin FROM (SELECT DISTINCT page_id, page_content FROM scanned_pages) WHERE regexp_matches(page_content, '[०-९]')")
def digit_map(spark, sf_dir):
    pages = table(spark, sf_dir, "scanned_pages").where(F.col("page_content").rlike("[०-९]")).select("page_id", "page_content").dropDuplicates()
    return pages.select("page_id", F.translate("page_content", "०१२३४५६७८९", "0123456789").alias("latin"))


@query("SELECT id, line_no, marker, body FROM (SELECT id, i - 1 AS line_no, nullif(regexp_extract(line, '^\\s*([-*•]|\\d+[.)])\\s', 1), '') AS marker, regexp_replace(line, '^\\s*([-*•]|\\d+[.)])\\s+', '') AS body FROM (SELECT id, unnest(string_split(response, chr(10))) AS line, generate_subscripts(string_split(response, chr(10)), 1) AS i FROM (SELECT DISTINCT id, response FROM query_log))) WHERE marker IS NOT NULL")
def line_structure(spark, sf_dir):
    lines = table(spark, sf_dir, "query_log").select("id", "response").dropDuplicates().select("id", F.posexplode(F.split("response", "\n")).alias("line_no", "line"))
    marker = F.nullif(F.regexp_extract("line", r"^\s*([-*•]|\d+[.)])\s", 1), F.lit(""))
    return lines.select("id", F.col("line_no").cast("long").alias("line_no"), marker.alias("marker"), F.regexp_replace("line", r"^\s*([-*•]|\d+[.)])\s+", "").alias("body")).where("marker is not null")


@query("SELECT id, n AS replies, CAST(coalesce(nullif(regexp_extract(response, '(^|[^0-9])([1-5])([^0-9]|$)', 2), ''), '3') AS INTEGER) AS score FROM (SELECT id, count(*) AS n, max(response) AS response FROM query_log GROUP BY id)")
def judge_parse(spark, sf_dir):
    once = table(spark, sf_dir, "query_log").groupBy("id").agg(F.count("*").alias("replies"), F.max("response").alias("response"))
    return once.select("id", "replies", F.coalesce(F.nullif(F.regexp_extract("response", r"(^|[^0-9])([1-5])([^0-9]|$)", 2), F.lit("")), F.lit("3")).cast("int").alias("score"))


@query()
def answer_events(spark, sf_dir):
    return ingest.answer_events(table(spark, sf_dir, "query_log"), "id", "response")
