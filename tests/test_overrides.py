"""The best override of every log row against brute force."""

import random

from loomdoc import lexicon
from loomdoc.functions import text as T
from loomdoc.operators.similarity import nearest_set
from loomdoc.plans import retrieval


def best(log, overrides, threshold):
    out = {}
    for i, a in log:
        for q, b in overrides:
            if a and b and (sim := len(set(a) & set(b)) / len(set(a) | set(b))) >= threshold:
                out[i] = min(out.get(i, (0, 0)), (-sim, q))
    return {i: (q, round(-sim, 6)) for i, (sim, q) in out.items()}


def test_nearest_set_equals_brute_force(spark):
    rng = random.Random(5)
    draw = lambda: rng.sample("abcdefgh", rng.randint(0, 6))
    log, overrides = [(f"l{i % 90}", draw()) for i in range(120)], [(i % 70, draw()) for i in range(100)]
    got = nearest_set(spark.createDataFrame(log, "key string, tokens array<string>"), spark.createDataFrame(overrides, "key long, tokens array<string>"), 0.65)
    assert {r["id"]: (r["question_id"], r["similarity"]) for r in got.collect()} == best(log, overrides, 0.65)


def test_every_override_can_match(spark, sf):
    tokens = lambda name, key, text: [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(key, T.tokens(retrieval.F.col(text))).collect()]
    want = best(tokens("query_log", "id", "query"), tokens("kpi_test_questions", "question_id", "question"), lexicon.FUZZY)
    rows = retrieval.override_fuzzy_all(spark, sf).collect()
    assert {r["id"]: (r["question_id"], r["similarity"]) for r in rows} == want
    assert any(r["question_id"] % 20 for r in rows)
