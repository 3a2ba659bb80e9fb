"""Questions scored against the chunks of every source."""

from loomdoc.operators import retrieve
from loomdoc.plans import retrieval


def test_other_sources_rank_and_no_source_is_needed(spark):
    questions = spark.createDataFrame([(20, "late bid opening", "a.pdf"), (40, "earnest money amount", None), (60, None, "a.pdf"), (80, "Late BID opening?", "b.pdf")], "question_id long, question string, source_file string")
    chunks = spark.createDataFrame([("c1", "a.pdf", "opening"), ("c2", "b.pdf", "rule 165 late bid opening"), ("c3", "b.pdf", "earnest money amount"), ("c4", "c.pdf", None)], "chunk_id string, source string, page_content string")
    for block in (1, 2, 2048):
        rows = retrieve.scored_all(questions, chunks, 2, block).orderBy("question_id", "rank").collect()
        got = [(r["question_id"], r["chunk_id"], r["score"]) for r in rows]
        assert got == [(20, "c2", 23), (20, "c1", 1), (40, "c3", 13), (40, "c1", 0), (60, "c1", 0), (60, "c2", 0), (80, "c2", 23), (80, "c1", 1)]
    assert retrieve.scored_all(questions, chunks.where("false"), 2).count() == 0


def test_other_sources_are_found(spark, sf):
    questions = {r["question_id"]: r["source_file"] for r in spark.read.parquet(f"{sf}/kpi_test_questions.parquet").collect()}
    sources = {r["chunk_id"]: r["source"] for r in spark.read.parquet(f"{sf}/chunks.parquet").collect()}
    assert any(sources[r["chunk_id"]] != questions[r["question_id"]] for r in retrieval.retrieve_topk_all(spark, sf).collect())
