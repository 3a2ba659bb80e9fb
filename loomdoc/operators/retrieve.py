"""Retrieval over many questions at once: expansion, scoring, continuation, context packing, ranking measures."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdoc import lexicon
from loomdoc.functions import text as T
from loomdoc.operators.ranking import spread_before
from loomdoc.operators.similarity import jaccard_join
from loomdoc.session import cut

#: What a term, rule or topic that question and chunk have in common adds to the score.
WEIGHTS = {"term": 1, "rule": 20, "topic": 5}


def sub_queries(question: Column) -> Column:
    """The question, the question with each of its topics, and its rules; distinct, in order."""
    return F.array_distinct(F.concat(F.array(question), F.transform(T.topics(question), lambda t: F.concat(question, F.lit(" "), t)), F.transform(T.query_rules(question), lambda r: F.concat(F.lit("Rule "), r))))


def search_queries(question: Column) -> Column:
    """What is searched for a question: itself, spelt right, with each of its topics, and its rules in both languages, with the number that a scan may have made of them."""

    def forms(r: Column) -> Column:
        both = lambda n: F.array(F.concat(F.lit("Rule "), n), F.concat(F.lit("नियम "), n))
        return F.when(T.misread_rule(r).isNotNull(), F.concat(both(r), both(T.misread_rule(r)))).otherwise(both(r))

    n = T.normalize_query(question)
    return F.array_distinct(F.concat(F.array(n), F.transform(T.topics(n), lambda t: F.concat(n, F.lit(" "), t)), F.flatten(F.transform(T.query_rules(n), forms))))


def _features(text: Column, rules: Column) -> Column:
    """Terms, rules and topics of a text as one array of distinct hashes, each with its weight in the lowest byte."""
    mark = lambda kind, c: F.transform(c, lambda x: F.shiftleft(F.xxhash64(F.lit(kind), x), 8).bitwiseOR(F.lit(WEIGHTS[kind]).cast("long")))
    return F.array_sort(F.concat(mark("term", T.tokens(text)), mark("rule", rules), mark("topic", T.topics(text))))


def _feature_blocks(df: DataFrame, size: int, name: str, by: list[str]) -> tuple[DataFrame, int]:
    """Blocks of at most about ``size`` rows of (key, features), of one group of ``by``, by hash of the key: keys, numbers of features, features on end; and into how many a group is cut."""
    df = cut(df)  # counted and cut into blocks: features are found once
    n = max(1, math.ceil(df.count() / size))
    rows = df.select(*by, F.pmod(F.xxhash64("key"), F.lit(n)).cast("int").alias("b"), F.struct("key", "features").alias("x"))
    x = rows.groupBy(*by, "b").agg(F.collect_list("x").alias("x"))
    return x.select(*by, "b", F.col("x.key").alias(f"{name}_keys"), F.transform("x", lambda r: F.size(r["features"])).alias(f"{name}_sizes"), F.flatten("x.features").alias(f"{name}_features")), n


def scored(questions: DataFrame, chunks: DataFrame, k: int, by: str | None = None, block: int = 2048) -> DataFrame:
    """(question_id, chunk_id, score, rank): the best k chunks for each question, of all or of those with its value of ``by``; ties by chunk_id.

    Blocks of questions meet blocks of chunks as in ``vector.nearest``; what is ranked at the end is k
    rows per question and block of chunks. Questions with equal terms, rules and topics are scored
    once. Chunks that have nothing in common score 0. A null value of ``by`` has no chunks.
    """
    group = [by] if by else []
    asked = questions.select("question_id", *group, _features(F.col("question"), T.query_rules(F.col("question"))).alias("features")).dropDuplicates()
    asked = asked.withColumn("key", F.xxhash64(*group, "features"))
    classes = asked.groupBy(*group, "key").agg(F.first("features").alias("features"))
    posts = chunks.select(*group, F.col("chunk_id").alias("key"), _features(F.col("page_content"), T.cited_rules(F.col("page_content"))).alias("features"))
    (left, _), (right, parts) = _feature_blocks(classes, block, "q", group), _feature_blocks(posts, block, "c", group)
    meets = left.drop("b").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))  # each block of questions meets every block of its chunks, in tasks of their own
    pairs = meets.join(right.hint("shuffle_hash"), [*group, "b"])

    def top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for qk, qn, qf, ck, cn, cf in zip(*[batch[f"{side}_{part}"] for side in "qc" for part in ("keys", "sizes", "features")]):
                qf, cf = np.asarray(qf, dtype=np.int64), np.asarray(cf, dtype=np.int64)
                order = np.argsort(np.asarray(ck, dtype=object))
                place = np.empty(len(order), dtype=np.int64)
                place[order] = np.arange(len(order))
                ck = np.asarray(ck, dtype=object)[order]
                known = np.unique(qf)
                weights = np.zeros((len(known), len(ck)), dtype=np.uint8)
                column = np.repeat(place, cn)
                if len(known):
                    row = np.minimum(np.searchsorted(known, cf), len(known) - 1)
                    hit = known[row] == cf
                    weights[row[hit], column[hit]] = (cf[hit] & 255).astype(np.uint8)
                ends, rows = np.cumsum(qn), np.searchsorted(known, qf)
                most, later = min(k, len(ck)), np.arange(len(ck))[::-1]
                best = np.empty((len(qk), most), dtype=np.int64)
                for i, (end, n) in enumerate(zip(ends, qn)):
                    # Score and place in one number, which puts equal scores in order of chunk_id.
                    ranked = weights[rows[end - n : end]].sum(axis=0, dtype=np.int64) * len(ck) + later
                    best[i] = np.partition(ranked, len(ck) - most)[len(ck) - most :]
                yield pd.DataFrame({"key": np.repeat(np.asarray(qk, dtype=np.int64), most), "chunk_id": ck[len(ck) - 1 - best % len(ck)].ravel(), "score": (best // len(ck)).ravel()})

    found = pairs.select(*[f"{side}_{part}" for side in "qc" for part in ("keys", "sizes", "features")]).mapInPandas(top, "key long, chunk_id string, score long")
    ranking = Window.partitionBy("key").orderBy(F.desc("score"), "chunk_id")
    ranked = found.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= k)
    return asked.select("question_id", "key").join(ranked, "key").select("question_id", "chunk_id", "score", "rank")


def scored_all(questions: DataFrame, chunks: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """The best k of all chunks for each question: see ``scored``."""
    return scored(questions, chunks, k, None, block)


def search(questions: DataFrame, chunks: DataFrame, k: int = 10, per_query: int = 40, cap: int = 3, deep_cap: int = 25, deep: str = "gfr|store purchase|cg hindi", most: int = lexicon.CONTEXT_CHARS) -> DataFrame:
    """(question_id, rank, chunk_id, source_db, source, score, taken): the k best chunks of each question and how much of each its context takes.

    Each of a question's search queries finds ``per_query`` chunks in either store, in blocks (``scored``). What
    several find counts once, where it was found first; a source may give ``cap`` chunks, in the order they
    were found, or ``deep_cap`` if its name says that it is a deep one. Where the question names a rule by number,
    chunks that cite it stay, with the two after each, unless none does. Contexts are packed in reading order.
    All windows are over one question, whose rows ``per_query`` and the number of its queries bound.
    """
    chunks = cut(chunks.select("chunk_id", "source_db", "source", "chunk_index", "page_content", "original_hindi"))  # read for features and again for what is found
    asked = questions.select("question_id", "question", F.posexplode(search_queries(F.col("question"))).alias("sub", "text"))
    both = asked.select((F.col("question_id") * 1000 + F.col("sub")).alias("question_id"), F.col("text").alias("question"), F.explode(F.array(F.lit("vendor"), F.lit("govt"))).alias("source_db"))
    top = scored(both, chunks, per_query, "source_db").select(F.floor(F.col("question_id") / 1000).cast("long").alias("question_id"), (F.col("question_id") % 1000).alias("sub"), "rank", "chunk_id")
    first = top.groupBy("question_id", "chunk_id").agg(F.min(F.struct("sub", "rank")).alias("f"))
    held = first.join(chunks.withColumn("source", T.display_source(F.col("source"))), "chunk_id")
    held = held.withColumn("found", F.struct((F.col("source_db") != "vendor").alias("store"), "f.sub", "f.rank", "chunk_id")).drop("f")
    by_source = Window.partitionBy("question_id", "source").orderBy("found")
    capped = held.withColumn("_n", F.row_number().over(by_source)).where(F.col("_n") <= F.when(F.lower("source").rlike(deep), deep_cap).otherwise(cap)).drop("_n")
    n = T.normalize_query(F.col("question"))
    wanted = questions.select("question_id", T.tokens(n).alias("_qt"), T.query_rules(n).alias("_qr"), T.topics(n).alias("_qs"), n.rlike("[0-9]").alias("_digit"))
    score = F.size(F.array_intersect("_qt", T.tokens(F.col("page_content")))) + 20 * F.size(F.array_intersect("_qr", T.cited_rules(F.col("page_content")))) + 5 * F.size(F.array_intersect("_qs", T.topics(F.col("page_content"))))
    rules = F.concat("_qr", F.array_compact(F.transform("_qr", T.misread_rule)))
    cited = T.mentioned_rules(F.concat_ws(" ", "page_content", "original_hindi"))
    of_question = Window.partitionBy("question_id")
    rated = capped.join(wanted, "question_id").withColumns({"score": score.cast("long"), "_hit": F.col("_digit") & F.arrays_overlap(cited, rules)})
    matched = rated.withColumn("_hits", F.collect_set(F.when(F.col("_hit"), F.struct("source", "chunk_index"))).over(of_question))
    near = F.exists("_hits", lambda h: (h["source"] == F.col("source")) & F.col("chunk_index").between(h["chunk_index"], h["chunk_index"] + 2))
    kept = matched.where((F.size("_hits") == 0) | near)
    best = kept.withColumn("rank", F.row_number().over(of_question.orderBy(F.desc("score"), "found"))).where(F.col("rank") <= k)
    sized = best.withColumn("_n", F.length(T.truncate(F.col("page_content"))))
    before = F.coalesce(F.sum("_n").over(of_question.orderBy("source", "chunk_index", "chunk_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = most - F.col("_before")
    taken = F.when(F.col("_n") <= rest, F.col("_n")).when(rest > lexicon.LEAST_REST, rest).otherwise(0)
    return sized.withColumn("_before", before).select("question_id", "rank", "chunk_id", "source_db", "source", "score", taken.cast("long").alias("taken"))


def with_continuation(chunks: DataFrame, hit: Column, after: int = 2) -> DataFrame:
    """Chunks that match and the ``after`` next ones of the same file, by key and not by place in the result."""
    keys = ["source_db", "source", "file_path"]
    wanted = chunks.where(hit).select(*keys, F.explode(F.sequence(F.col("chunk_index"), F.col("chunk_index") + after)).alias("chunk_index")).distinct()
    return chunks.join(wanted, [*keys, "chunk_index"], "left_semi")


def pack_context(chunks: DataFrame, keys: list[str], order: str, key: str, text: str, most: int = lexicon.CONTEXT_CHARS) -> DataFrame:
    """(keys, key, taken): how many characters of each chunk go into the context of its group, in reading order.

    Taking stops at the first chunk that does not fit; a part of it is taken if more than LEAST_REST
    characters are left. A running sum decides this exactly, over ranges of each group, whose size is not bounded.
    """
    n = F.least(F.length(text), F.lit(lexicon.CHUNK_CHARS))
    summed = spread_before(chunks.select(*keys, key, order, n.alias("n")), keys, [F.col(order).asc(), F.col(key).asc()], "n")
    fits = F.col("before") + F.col("n") <= most
    return summed.where(fits | ((F.col("before") <= most) & (most - F.col("before") > lexicon.LEAST_REST))).select(*keys, key, F.when(fits, F.col("n")).otherwise(most - F.col("before")).cast("long").alias("taken"))


#: Letters of a snippet, of the beginning by which it is looked up, and of the windows of that.
SNIPPET, BEGINNING, WINDOW = 80, 30, 16
#: Places of the filter of the windows that are looked up: of fixed size, without false negatives.
_BITS = 1 << 24


def _least_windows(text: np.ndarray, window: int, of: int) -> np.ndarray:
    """Hashes of the windows that are the least of some ``of`` windows in a row."""
    if len(text) < window:
        return np.zeros(0, dtype=np.int64)
    h = np.zeros(len(text) - window + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(window):
            h = h * np.uint64(0x100000001B3) + text[i : i + len(h)]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    h = h.view(np.int64)
    return np.unique(np.lib.stride_tricks.sliding_window_view(h, of).min(axis=1)) if len(h) >= of else h[:0]


def holders(snippets: DataFrame, pieces: DataFrame, key: str, group: str, text: str, place: str) -> DataFrame:
    """(key, place) of the pieces of the same group whose letters hold the first SNIPPET letters of a snippet (key, group, "key").

    Only windows that some snippet looks up leave a task. A snippet that a text holds has the same least window of its
    beginning there (winnowing), so that both meet in a join on it and the group, and no true pair is lost; the texts
    are compared after it. Snippets of fewer than BEGINNING letters are looked for nowhere.
    """
    of = BEGINNING - WINDOW + 1

    def code(t: str) -> np.ndarray:
        return np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["_w"] = [int(_least_windows(code(t[:BEGINNING]), WINDOW, of)[0]) for t in batch["_snippet"]]
            yield batch

    asked = snippets.where(F.length("key") >= BEGINNING).select(key, group, F.substring("key", 1, SNIPPET).alias("_snippet"))
    s = cut(asked.mapInPandas(ask, f"{key} {snippets.schema[key].dataType.simpleString()}, {group} string, _snippet string, _w long"))
    at = f"pmod(_w, {_BITS})"
    whole = bytearray(_BITS // 8)
    for r in s.groupBy(F.expr(f"cast({at} div 32768 as int)").alias("b")).agg(F.expr(f"bitmap_construct_agg({at} % 32768)").alias("bits")).collect():  # of fixed size: 2 MB
        whole[r["b"] * 4096 : r["b"] * 4096 + 4096] = r["bits"]
    bits = snippets.sparkSession.sparkContext.broadcast(bytes(whole))

    def offer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        looked = np.unpackbits(np.frombuffer(bits.value, dtype=np.uint8), bitorder="little").view(bool)
        for batch in batches:
            rows = []
            for g, p, t in zip(batch[group], batch[place], batch["_text"]):
                found = _least_windows(code(t), WINDOW, of)
                rows += [(g, p, t, int(w)) for w in found[looked[found % _BITS]]]
            yield pd.DataFrame(rows, columns=[group, place, "_text", "_w"])

    body = pieces.select(group, place, T.snippet_key(F.col(text)).alias("_text")).where(F.length("_text") >= BEGINNING)
    o = body.mapInPandas(offer, f"{group} string, {place} {pieces.schema[place].dataType.simpleString()}, _text string, _w long")
    return s.join(o, [group, "_w"]).where(F.contains("_text", F.col("_snippet"))).select(key, place)


def recall(first: DataFrame, by: list[str]) -> DataFrame:
    """Share of queries whose first relevant rank is within 1, 3, 5 and 10."""
    return first.groupBy(*by).agg(F.count("*").alias("queries"), *[F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}") for k in (1, 3, 5, 10)])


def dislike_penalty(disliked: DataFrame, questions: DataFrame, near_query: float = 0.4, near_answer: float = 0.3, weight: int = 50) -> DataFrame:
    """(question_id, dislikes, penalty): disliked log rows whose query and answer are both more alike than given to the question and its context."""
    log = disliked.select("id", T.tokens(F.col("query")).alias("tokens"), T.tokens(F.col("response")).alias("answer"))
    asked = questions.select("question_id", T.tokens(F.col("question")).alias("tokens"), T.tokens(F.col("ground_truth_context")).alias("context"))
    near = jaccard_join(log.select(F.col("id").alias("key"), "tokens"), asked.select(F.col("question_id").alias("key"), "tokens"), near_query).where(F.col("similarity") > near_query)
    both = near.join(log.select(F.col("id").alias("l"), "answer"), "l").join(asked.select(F.col("question_id").alias("r"), "context"), "r").where(T.jaccard(F.col("answer"), F.col("context")) > near_answer)
    return both.groupBy(F.col("r").alias("question_id")).agg(F.count("*").alias("dislikes"), (F.lit(-weight) * F.count("*")).alias("penalty"))
