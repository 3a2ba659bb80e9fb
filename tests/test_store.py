"""What changes stored tables, joins of hot keys, snippets and searches, on small cases."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomdoc.functions import text as T
from loomdoc.operators import ingest, logs, retrieve
from loomdoc.operators.ranking import spread_join
from loomdoc.sources import files

AT = datetime(2024, 1, 1)


def test_feedback_is_the_last_valid_one(spark):
    log = spark.createDataFrame([("a",), ("b",), ("c",)], "id string").withColumn("updates", F.lit("clash"))
    events = spark.createDataFrame([("a", "satisfied", 1), ("a", " Unsatisfied ", 2), ("a", "great", 3), ("b", None, 1), ("b", "great", 2), ("x", "satisfied", 1)], "id string, feedback string, at int")
    assert sorted(map(tuple, logs.with_feedback(log, events).collect())) == [("a", "unsatisfied", 2), ("b", "neutral", 0), ("c", "neutral", 0)]


def test_phrase_is_not_logged(spark):
    log = spark.createDataFrame([("a", " open SESAME "), ("b", "open"), ("c", None)], "id string, query string")
    assert sorted(r["id"] for r in logs.without_phrase(log, "Open sesame").collect()) == ["b", "c"]


def test_collections_are_dropped_and_logs_grow(spark, tmp_path):
    files.write_store(spark.createDataFrame([("1", "vendor"), ("2", "govt")], "chunk_id string, source_db string"), f"{tmp_path}/store")
    files.drop_collections(spark, f"{tmp_path}/store", ["vendor", "unknown"])
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/store").collect()] == [("2", "govt")]
    for i in "ab":
        files.append_log(spark.createDataFrame([(i, AT)], "id string, received_at timestamp_ntz"), f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2
    files.write_config(spark.createDataFrame([("5", "no")], "k string, odd string"), f"{tmp_path}/config", ["k", "temperature"])
    assert [r.asDict() for r in files.read_config(spark, f"{tmp_path}/config", {"k": "10", "temperature": "0"}).collect()] == [{"k": "5", "temperature": "0"}]


def test_toggled(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["x"])], "m array<string>, i array<string>")
    assert [r[0] for r in df.select(T.toggled(F.col("m"), F.col("i"))).collect()] == [["a", "c"], ["x"]]


@pytest.mark.parametrize("least", [0, 3, 10**9])
def test_spread_join_equals_join(spark, least):
    rng = random.Random(1)
    left = spark.createDataFrame([(rng.choice([1, 1, 1, 2, 3, None]), i) for i in range(200)], "k int, i int")
    right = spark.createDataFrame([(1, "x", 9), (2, "y", 2), (4, "z", 1)], "k int, v string, n int")
    got = spread_join(left, right, ["k"], F.col("n") >= least)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "k").collect())) and got.count() > 0


def test_holders_equal_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 9)))
    texts = [" ".join(word() for _ in range(60)) for _ in range(30)] + ["", "short", None]
    pieces = [(f"s{i % 3}", i, t) for i, t in enumerate(texts)]
    wanted = [(i, f"s{rng.randint(0, 2)}", "".join(c for c in texts[rng.randint(0, 29)] if c != " ")[(at := rng.randint(0, 150)) : at + rng.choice([29, 30, 45, 80, 120])]) for i in range(120)]
    found = retrieve.holders(spark.createDataFrame(wanted, "q int, source string, key string"), spark.createDataFrame(pieces, "source string, place int, text string"), "q", "source", "text", "place")
    truth = {(q, i) for q, s, k in wanted if len(k) >= 30 for g, i, t in pieces if g == s and t and k[:80] in t.replace(" ", "")}
    assert {tuple(r) for r in found.collect()} == truth and len(truth) > 10


def test_disliked_answers_count_against_their_question(spark):
    log = spark.createDataFrame([("a", "tender fee refund delay portal", "refund within thirty days portal"), ("b", "tender fee refund delay portal", "other words entirely here"), ("c", "unrelated query words", "refund within thirty days portal"), ("d", None, None)], "id string, query string, response string")
    asked = spark.createDataFrame([(20, "tender fee refund delay office", "refund within thirty days office"), (40, "", None)], "question_id long, question string, ground_truth_context string")
    assert [tuple(r) for r in retrieve.dislike_penalty(log, asked).collect()] == [(20, 1, -50)]


def test_search_filters_by_rule_and_packs(spark):
    text = lambda i: ("Rule 170 says so. " if i == 3 else "") + f"bid security amount is kept here {'x' * 900}"
    chunks = spark.createDataFrame([(f"c{i}", "govt", "gfr.pdf", i, text(i), None) for i in range(8)] + [("v", "vendor", "guide.txt", 0, "bid security for vendors", None)], "chunk_id string, source_db string, source string, chunk_index int, page_content string, original_hindi string")
    asked = spark.createDataFrame([(20, "what does rule 170 say on bid security"), (40, "bid security amount"), (60, None)], "question_id long, question string")
    got = retrieve.search(asked, chunks, k=5).collect()
    assert {r["chunk_id"] for r in got if r["question_id"] == 20} == {"c3", "c4", "c5"}
    packed = sorted(((r["source"], r["chunk_id"]), r["taken"]) for r in got if r["question_id"] == 40)
    assert len(packed) == 5 and sum(t for _, t in packed) <= 4000 and all(r["source"] != "guide.txt" for r in got)
    assert retrieve.search(asked.where("false"), chunks).count() == 0 and retrieve.search(asked, chunks.where("false")).count() == 0


def test_recursive_chunks_cover_the_given_texts(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("text is not null").collect()
    for r in rows:
        pieces, at = ingest.split_recursive(r["text"]), 0
        assert all(0 < len(p) <= 1000 for p in pieces)
        squeezed = "".join(r["text"].split())
        for p in pieces:  # each is found in the text, none before the one before it, and nothing is between them but the mark that they are cut at
            p = "".join(p.split())
            start = squeezed.find(p, max(0, at - 1000 - len(p)))
            assert 0 <= start and squeezed[at:start] in ("", ".", "।")
            at = max(at, start + len(p))
        assert squeezed[at:] in ("", ".", "।")
