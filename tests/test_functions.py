"""Small cases of functions and operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdoc.functions import text as T
from loomdoc.functions import vector
from loomdoc.operators import ingest, logs, ranking, retrieve
from loomdoc.operators.similarity import jaccard_join
from loomdoc.sources import files


def one(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(c) for c in df.columns]).alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "route"), [("EMD kya hai, in english", "en"), ("EMD kab milega", "hi-Latn"), ("निविदा क्या है", "hi"), ("What is EMD", "en"), (None, "en"), ("", "en")])
def test_route(spark, text, route):
    assert one(spark, T.route_language, text) == route


@pytest.mark.parametrize(("text", "clean"), [("tendor emc", "tender emd"), ("submitting", "submiting"), ("tenders bidding", "tender bid submission"), (None, None)])
def test_spelling(spark, text, clean):
    assert one(spark, T.normalize_query, text) == clean


def test_script_share(spark):
    assert one(spark, T.devanagari_share, "नियम rule") == 0.5
    assert one(spark, T.devanagari_share, "12 34") is None


def test_jaccard(spark):
    f = lambda a, b: T.jaccard(T.tokens(a), T.tokens(b))
    assert one(spark, f, "What is the EMD rule", "EMD amount") == 0.5
    assert one(spark, f, "what is the", "anything") == 0.0
    assert one(spark, f, None, "x") == 0.0


@pytest.mark.parametrize("n", [2499, 2500, 2501])
def test_truncate_lengths(spark, n):
    text = " " + "x" * (n - 2) + " "
    assert one(spark, T.truncate, text) == (text if n <= 2500 else text[:2500].strip())


def test_truncate_boundaries(spark):
    assert one(spark, T.truncate, "a" * 2200 + "\n\n" + "b" * 900) == "a" * 2200
    assert one(spark, T.truncate, "a" * 2200 + ". " + "b" * 900) == "a" * 2200 + "."


def test_rules(spark):
    assert one(spark, T.query_rules, "rule 4.3.1 late bid") == ["4", "165"]
    assert one(spark, lambda c: T.misread_rule(c), "170") == "470"
    assert one(spark, lambda c: T.misread_rule(c), "270") is None


def test_point_key_is_uuid5(spark):
    import uuid

    assert one(spark, T.point_key, "vendor_x_chunk_0001") == str(uuid.uuid5(uuid.NAMESPACE_DNS, "vendor_x_chunk_0001"))


def test_pack_stops_at_first_overflow(spark):
    def taken(lengths):
        df = spark.createDataFrame([("g", i, f"c{i}", "x" * n) for i, n in enumerate(lengths)], "g string, i int, k string, t string")
        return [r["taken"] for r in retrieve.pack_context(df, ["g"], "i", "k", "t").orderBy("k").collect()]

    assert taken([900] * 5) == [900] * 4
    assert taken([1500] * 3) == [1500, 1500, 1000]
    assert taken([1750, 1750, 600]) == [1750, 1750]  # 500 left are too few
    assert taken([1750, 1749, 600]) == [1750, 1749, 501]
    assert taken([]) == []


def test_recursive_split_keeps_size_and_text():
    rng = random.Random(1)
    text = "\n\n".join(". ".join(" ".join("w" * rng.randint(1, 9) for _ in range(12)) for _ in range(6)) for _ in range(20))
    parts = ingest.split_recursive(text, 200, 30)
    assert max(map(len, parts)) <= 200
    assert set(text.split()) <= set(" ".join(parts).split()) | {w.rstrip(".") for w in text.split()} | {w + "." for w in " ".join(parts).split()}
    assert ingest.split_recursive("short", 200, 30) == ["short"]


def test_merged_lines(spark):
    df = spark.createDataFrame([(1, "one\ntwo.\nthree\n- four\n\nfive"), (2, None), (3, "")], "k int, t string")
    got = {r["k"]: r["paragraphs"] for r in ingest.merged_lines(df, "k", "t").collect()}
    assert got == {1: ["one two.", "three", "- four", "five"], 2: [], 3: []}


def test_jaccard_join_loses_nothing(spark):
    rng = random.Random(3)
    rows = [(i, sorted(set(rng.choices("abcdefghij", k=rng.randint(0, 6))))) for i in range(120)] + [(None, ["a"])]
    df = spark.createDataFrame(rows, "key int, tokens array<string>")
    for threshold in (0.4, 0.65, 1.0):
        want = {(a, b) for a, s in rows for b, t in rows if a is not None and b is not None and s and t and len(set(s) & set(t)) / len(set(s) | set(t)) >= threshold}
        assert {(r["l"], r["r"]) for r in jaccard_join(df, df, threshold).collect()} == want
    assert jaccard_join(df.where("false"), df, 0.5).count() == 0


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(300, 8)).round(2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(998, None), (None, [1.0] * 8)], "id long, v array<double>")
    got = {(r["query_key"], r["rank"]): r["key"] for r in vector.nearest(df, df.where("id < 20"), "id", "v", 5, block=64).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(20):
        order = sorted(range(300), key=lambda p: (-round(float(u[q] @ u[p]), 6), p))[:5]
        assert [got[(q, r)] for r in range(1, 6)] == order


def test_positions_of_a_hot_group(spark):
    rows = [("hot", i) for i in range(400)] + [(f"k{i % 50}", i) for i in range(200)] + [(None, 1), (None, 0)]
    df = spark.createDataFrame(rows, "k string, t int").withColumn("id", F.monotonically_increasing_id())
    got = ranking.spread_positions(df, ["k"], [F.col("t").asc(), F.col("id").asc()], partitions=7).collect()
    assert sorted(r["position"] for r in got if r["k"] == "hot") == list(range(1, 401))
    assert all(r["position"] == r["t"] + 1 for r in got if r["k"] in ("hot", None))


def test_usage_of_nothing(spark):
    df = spark.createDataFrame([], "id string, query string, response string, response_time_seconds double, feedback string")
    r = logs.usage(df, []).first()
    assert (r["total_queries"], r["avg_response_time"], r["satisfaction_rate"]) == (0, 0.0, 100.0)


def test_sessions_end_after_more_than_an_hour(spark):
    from datetime import datetime, timedelta

    t = datetime(2024, 1, 1)
    for gap, n in ((3599, 1), (3600, 1), (3601, 2)):
        df = spark.createDataFrame([(1, t), (1, t + timedelta(seconds=gap)), (None, t), (2, None)], "u int, ts timestamp")
        assert logs.sessionize(df, "u", "ts").count() == n


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1")], "k string, v string")
    new = spark.createDataFrame([("b", "2"), ("c", "2")], "k string, v string")
    first = ingest.upsert(old, new, "k")
    assert sorted(map(tuple, first.collect())) == [("a", "1"), ("b", "2"), ("c", "2")]
    assert sorted(map(tuple, ingest.upsert(first, new, "k").collect())) == sorted(map(tuple, first.collect()))


def test_files(spark, tmp_path):
    import zipfile

    (tmp_path / "a.txt").write_bytes("नियम\xff 1".encode("latin-1", "ignore") or b"x")
    (tmp_path / "~$b.txt").write_bytes(b"lock")
    with zipfile.ZipFile(tmp_path / "c.DOCX", "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="u"><w:p><w:t>Hello</w:t><w:t>there</w:t></w:p></w:d>')
    (tmp_path / "bad.docx").write_bytes(b"no archive")
    got = {r["source"]: r["page_content"] for r in files.read_files(spark, str(tmp_path), "vendor").collect()}
    assert got["c.DOCX"] == "Hello there"
    assert got["bad.docx"] == ""
    assert set(got) == {"a.txt", "c.DOCX", "bad.docx"}
