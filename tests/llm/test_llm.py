"""Operators of the llm subpackage: brute force, round trips, defined results for the odd rows."""

import hashlib
import itertools
import math
import random
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdoc.llm import conversations, encoding, language, mixing, packing, pairs, personal, queries, repeated, scanned, tokens

SAMPLE = {
    "en": ["What is the procedure for bank guarantee verification?", "Who approves the purchase order above the limit?", "The committee met and found the tender in order.", "The rates quoted remain firm for the year."] * 5,
    "hi": ["बैंक गारंटी की प्रक्रिया क्या है?", "कृपया दर अनुबंध से संबंधित नियम बताइए।", "समिति का निर्णय अंतिम माना जाएगा।"] * 5,
    "hi-Latn": ["bank guarantee ka process kya hai?", "portal par tender fees kaise jama kare?", "bid reject ho jaye to kya hoga?", "iske baare me niyam bataiye"] * 5,
    "mr": ["अनामत रक्कम भरण्याची पद्धत काय आहे?", "नियम नुसार निविदा शुल्क देणे बंधनकारक आहे."] * 5,
    "bn": ["জামানতের টাকা সম্পর্কে আমাকে জানান।", "পোর্টালে নথি আপলোড কীভাবে করব?"] * 5,
    "fr": ["Quelle est la procédure pour la garantie bancaire ?", "Le montant est remboursé sous trente jours.", "Comment puis-je payer la caution sur le portail ?"] * 5,
}


@pytest.fixture(scope="module")
def bayes():
    return language.NaiveBayes(SAMPLE)


@pytest.fixture(scope="module")
def parser():
    return language.CrossParser(SAMPLE)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_every_query_runs(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    rows = df.count()
    assert df.columns and rows > 0


# p1
@pytest.mark.parametrize(
    ("query", "response", "kind"),
    [
        ("What is EMD?", None, "empty"), ("What is EMD?", " ​\n", "empty"), ("What is EMD?", "Answer:", "empty"), ("What is EMD?", "<p></p>", "empty"),
        ("Who approves the tender?", "You asked: who approves the tender", "copy"), ("Who approves the tender above Rs. 5,000 in a year?", "Q: Who approves the tender above Rs 5000 in year", "copy"),
        ("Who approves the tender?", "I'm sorry, that is beyond my remit. Please contact the helpdesk.", "refusal"), ("bid ka niyam?", "Ye mere daayre se bahar hai.", "refusal"), ("नियम क्या है?", "क्षमा करें, मैं इस प्रश्न का उत्तर देने में असमर्थ हूँ।", "refusal"),
        ("Who approves the tender?", "The rates remain firm.\n1. The first.\n2.", "truncated"), ("Who approves the tender?", "The committee met. because of the", "truncated"),
        ("बैंक गारंटी की प्रक्रिया क्या है? जवाब इंग्लिश में चाहिए।", "The committee met and found the tender in order.", None), ("बैंक गारंटी की प्रक्रिया क्या है?", "The committee met and found the tender in order.", "other_language"),
        ("Who approves the tender?", "समिति का निर्णय अंतिम माना जाएगा।", "other_language"), ("Who approves the tender? Please reply in Hindi.", "समिति का निर्णय अंतिम माना जाएगा।", None),
        ("Who approves the tender?", "Sorry for the wait. The committee met and found the tender in order.", None), ("Who approves the tender?", "The committee met and found the tender in order. (Page 12)", None),
    ],
)
def test_defects(bayes, query, response, kind):
    assert pairs.defects([(query, response, pairs.EndModel({}, 100))], bayes) == [kind]


@pytest.mark.parametrize("times", [1, 40])
@pytest.mark.parametrize("nothing", ["<p></p>", "&nbsp;", "** \n", "​", "N/A"])
def test_nothing_said_is_empty_at_any_length(nothing, times):
    assert pairs.is_empty(" ".join([nothing] * (1 if nothing == "N/A" else times)))


def test_copy_and_refusal_have_no_size_limit():
    question = "Who approves the tender above Rs. 5,000 in a year at the office?"
    assert pairs.is_copy(question, "Thank you for writing to the procurement help desk of the district office today, this is the question that we have received from you: " + question)
    assert pairs.is_copy(question, "\n".join([question] * 50)) and not pairs.is_copy(question, question + " The committee approves it.")
    assert pairs.is_refusal("I cannot help with that" + " because the matter is with the committee" * 20 + ".")


def test_contexts_count_alike_at_every_size():
    texts = ["The committee met. Merci", "The committee met again.", "It closes. Merci", "See p. 4 of it", "and so on...", "It closes."] * 3
    small, large = pairs.count_ends(texts), pairs.count_ends(texts * 100)
    assert small["context"].tolist() == large["context"].tolist() and (small["places"] * 100).tolist() == large["places"].tolist()
    counts = {c: tuple(r) for c, *r in large.itertuples(index=False)}
    closing, cut, dots = pairs.last_contexts(["Also. Merci", "The committee", "and so on..."])
    assert [n for n, _ in closing] == [1, 2] and counts[closing[1][1]] == (600, 0, 600) and dots == []
    assert pairs.EndModel({n: counts[c] for n, c in closing if c in counts}, 1800).likely("Also. Merci") > 0.9
    assert pairs.EndModel({n: counts[c] for n, c in cut if c in counts}, 1800).likely("The committee") == 0


def test_posteriors_do_not_depend_on_their_neighbours(bayes):
    texts = [t for of in SAMPLE.values() for t in of[:4]] + ["", "12", "x" * 300_000]
    together = bayes.posteriors(texts)
    assert all(bayes.posteriors([t])[0][0] == lang and abs(bayes.posteriors([t])[0][1] - p) < 1e-4 for t, (lang, p) in zip(texts, together))
    assert [lang for lang, _ in together][-3:-1] == [None, None]


def test_labelled_sample_is_limited_before_its_shuffle(spark):
    rows = [(i, SAMPLE[x][i % 3], x) for i in range(900) for x in ("en", "fr")]
    df = spark.createDataFrame(rows, "k long, t string, lang string").withColumn("n", F.lit("clash"))
    sample = language.labelled_sample(df.select("k", "t", "lang", "n"), "k", "t", "lang", rows=400)
    assert 300 <= len(sample["en"]) <= 400 and 300 <= len(sample["fr"]) <= 400 and sample["hi"] == []


def test_broken_pairs_odd_rows(spark):
    rows = [("a", None, "x", None), ("b", "  ", "x", None), (None, "q?", None, None), ("c", "What is EMD?", None, None), ("c", "What is EMD?", None, None), ("d", "What is EMD?", "x" * 200_000 + ".", None)]
    df = spark.createDataFrame(rows, "id string, query string, response string, feedback string").withColumn("defect", F.lit("clash"))
    assert [tuple(r) for r in pairs.broken_pairs(df, SAMPLE).where("id = 'c'").collect()] == [("c", "empty", None)]
    assert pairs.broken_pairs(df.where("false"), SAMPLE).count() == 0


# p2
def brute_words(seen: dict[str, int]) -> dict[str, scanned.Word]:
    """Word by word what word_table finds by joins."""
    errors, chances = {}, {}
    for w, n in seen.items():
        for k, (_, written) in enumerate(scanned.CONFUSIONS):
            chances[k] = chances.get(k, 0) + n * (written in w)
        for v, k in scanned.variants(w):
            if n and seen.get(v, 0) >= 8 * n:
                errors[k] = errors.get(k, 0) + n
    rate = {k: min(0.2, max(1e-6, errors[k] / max(1, chances[k]))) if k in errors else 1e-6 for k in range(len(scanned.CONFUSIONS))}
    own = {}
    for w, n in seen.items():
        rivals = [(seen[v], rate[k]) for v, k in scanned.variants(w) if seen.get(v, 0) > 4 * n]
        own[w] = float(n) if n > max([6 * sum(m * r for m, r in rivals), *(scanned.OWN_WORD * m for m, _ in rivals)], default=0.0) else 0.0
    out = {}
    for w, n in seen.items():
        best: dict[str, float] = {}
        for v, k in scanned.variants(w):
            if own.get(v, 0) > own[w]:
                best[v] = max(best.get(v, -99.0), math.log(rate[k]))
        if not own[w] and not best and len(w) > 3:
            for v, k in scanned.variants(w):
                for u, j in scanned.variants(v):
                    if own.get(u, 0) > 0:
                        best[u] = max(best.get(u, -99.0), math.log(rate[k]) + math.log(rate[j]))
        out[w] = scanned.Word(n, own[w], tuple(sorted((v, round(p, 9), seen[v], own[v]) for v, p in best.items())))
    return out


def test_word_table_equals_brute_force(spark):
    rng = random.Random(3)
    base = ["tender", "certificate", "committee", "portal", "निविदा", "समिति", "bid", "office", "return", "modern"]
    seen: dict[str, int] = {w: rng.randint(200, 900) for w in base}
    for w in base:
        for v in {u for u in base + list(seen) for u in (u,) if u != w} | {v for u, _ in scanned.variants(w) for v in (u,)}:
            seen.setdefault(v, rng.choice([0, 1, 2, 5]))
    for w in list(seen)[:60]:
        for v, _ in list(scanned.variants(w))[:3]:
            seen.setdefault(v, rng.choice([0, 1, 3]))
    got = {r["word"]: scanned.Word(r["seen"], r["own"], tuple(sorted((o["option"], round(o["log"], 9), o["option_seen"], o["option_own"]) for o in r["options"] or ()))) for r in scanned.word_table(spark.createDataFrame(list(seen.items()), "word string, seen long")).collect()}
    assert got == brute_words(seen) and any(len(w.options) > 1 for w in got.values())


def test_page_repair():
    seen = {"the": 900, "tender": 500, "certificate": 300, "is": 900, "two-packet": 40, "open": 200, "for": 300, "tcnder": 1, "0pen": 1, "certif": 0, "icate": 0, "twopacket": 0}
    channel = scanned.Channel(brute_words(seen), 10_000, pairs={"the tender": 200, "tender is": 100})
    text = "Manual on bids\n12\n\nThe tcnder is 0pen\r\nfor 2,9o0 certif-\nicate the two-\npacket\n\nQty\n14\n190\nPage 12 of 20"
    found, clean = scanned.repair_page(text, 12, {scanned.header_key("Manual on bids", 12)}, channel)
    assert set(found) == {(1, "header", ""), (2, "page_number", ""), (4, "misread", "tender"), (4, "misread", "open"), (5, "misread", "2,900"), (5, "hyphen", "certificate"), (6, "hyphen", "two-packet"), (12, "page_number", "")}
    assert clean.startswith("The tender is open for 2,900 certificate the two-packet")


def test_header_lines_have_no_number(spark):
    """Three running lines at the top, in a file of many pages; a misread digit makes no other title."""
    body = "It was decided that the district office keeps all of the papers.\nNothing else was said about the matter at that time at all."
    pages = [(f"p{i}", "f", i, f"Manual of stores\nOffice edition, 2O1{i % 10}\nSecond revised part\n{i}\n{body}\nSee over") for i in range(1, 30)]
    df = spark.createDataFrame(pages, "page_id string, file_path string, page_num int, page_content string")
    found = {(f["line_no"], f["kind"]) for r in scanned.repair_scanned(df).collect() for f in r["found"] if f["kind"] != "misread"}
    assert found == {(1, "header"), (2, "header"), (3, "header"), (4, "page_number"), (7, "header")}


def test_same_items_in_a_hundred_times_the_corpus(spark):
    rng = random.Random(7)
    words = ["tender", "certificate", "committee", "portal", "office", "return", "payment", "minister", "quorum", "zamindar"]
    texts = [" ".join(rng.choice(words) for _ in range(40)).replace("tender", "tcnder" if i % 13 == 0 else "tender", 1) + "\nzamindar rare " + rng.choice(["lakhpati", "certif-\nicate of it"]) for i in range(40)]
    found = []
    for times in (1, 25):
        df = spark.createDataFrame([(f"p{i}", f"f{i}", 1, t) for i in range(40 * times) for t in [texts[i % 40]]], "page_id string, file_path string, page_num int, page_content string")
        found.append({(int(r["page_id"][1:]) % 40, *f) for r in scanned.repair_scanned(df).collect() for f in r["found"]})
    assert found[0] == found[1] and any(f[2] == "misread" and f[3] == "tender" for f in found[0])


def test_scanned_odd_rows(spark):
    df = spark.createDataFrame([("a", None, None, None), ("a", None, None, None), ("b", "f", 1, ""), (None, "f", 2, "x")], "page_id string, file_path string, page_num int, page_content string")
    assert sorted((r["page_id"], r["text"]) for r in scanned.repair_scanned(df).collect()) == [("a", ""), ("b", "")]
    assert scanned.repair_scanned(df.where("false")).count() == 0


# p3
def test_components_equal_union_find(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randint(0, 150):03d}", f"n{rng.randint(0, 150):03d}") for _ in range(110)] + [("hub", f"n{i:03d}") for i in range(0, 150, 7)] + [(None, "x"), ("y", "y")]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in conversations.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {n: find(n) for n in parent if find(n) != n}


def test_quotes_link_rows_without_session(spark):
    t = datetime(2024, 1, 1)
    rows = [("1", None, "2024-01-01T10:00:00", "Who approves it?", None, t), ("2", None, "2024-01-01T10:00:09", None, "> who approves it\nThe committee.", t), ("3", None, "2024-01-01T10:00:00", "Same words?", "x", t), ("4", None, "2024-01-01T10:00:00", "Same words?", "y", t)]
    df = spark.createDataFrame(rows, "id string, session_id string, timestamp string, query string, response string, received_at timestamp")
    got = {(r["conversation"], r["message_no"], r["log_id"]) for r in conversations.rebuild_conversations(df).collect()}
    assert got == {("c:1", 1, "1"), ("c:1", 2, "2"), ("c:3", 1, "3"), ("c:3", 2, "3"), ("c:4", 1, "4"), ("c:4", 2, "4")}


def test_conversations(spark):
    t = datetime(2024, 1, 1)
    rows = [
        ("1", " S1 ", "2024-01-01T10:00:00", "q1", None, t), ("2", "s1", "2024-01-01T04:30:05Z", None, "r1", t), ("3", "s1", "1704083410000", "q2", "r2", t), ("3", "s1", "1704083410000", "q2", None, t),
        ("4", "s2", "not recorded", "q", "r", t), ("5", "s3", "2024-01-01 10:00:00.5", "q", "N/A", t), ("6", "s4", "2024-01-01T10:00:00+05:30", "q", "r", None), ("7", None, "2024-01-01T10:00:00", "loose", "answer", t), ("8", "s5", None, None, None, t),
    ]
    df = spark.createDataFrame(rows, "id string, session_id string, timestamp string, query string, response string, received_at timestamp").withColumn("conversation", F.lit("clash"))
    got = [(r["session_id"], r["message_no"], r["speaker"], r["log_id"]) for r in conversations.rebuild_conversations(df).orderBy("conversation", "message_no").collect()]
    assert got == [(None, 1, "user", "7"), (None, 2, "assistant", "7"), ("s1", 1, "user", "1"), ("s1", 2, "assistant", "2"), ("s1", 3, "user", "3"), ("s1", 4, "assistant", "3"), ("s4", 1, "user", "6"), ("s4", 2, "assistant", "6")]
    assert conversations.rebuild_conversations(df.where("false")).count() == 0


# p4
@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp437", "mac_roman"])
@pytest.mark.parametrize("text", ["निविदा क्रमांक 12 के अंतर्गत दरें मान्य रहेंगी।", "the bidder’s “own risk” clause – § 4", "Rate: £4 or €4 per unit"])
@pytest.mark.parametrize("layers", [1, 2])
def test_garbling_round_trip(wrong, text, layers):
    table = {b: c for c, b in encoding._bytes_of(wrong).items()}
    garbled = text
    for _ in range(layers):
        garbled = "".join(table[b] for b in garbled.encode())
    assert encoding.repair(f"plain line\n{garbled}\nend") == (f"plain line\n{text}\nend", False)


@pytest.mark.parametrize("layers", [3, 5, 6])
def test_many_layers_come_off(layers):
    garbled = text = "the bidder’s “own risk” clause"
    for _ in range(layers):
        garbled = garbled.encode().decode("latin-1")
    assert encoding.repair(garbled) == (text, False)


@pytest.mark.parametrize("text", ["Supplied by GRÜNÄCKER & SÖHNE.", "Ångström Pumper, SÃO TOMÉ, ÎLE-DE-BOIS", "façade panels, 9 m², “as is”", "SOCIÉTÉ À RESPONSABILITÉ LIMITÉE", "", "नियम"])
def test_right_text_stays(text):
    assert encoding.repair(text) == (text, False)


def test_encoding_table(spark):
    df = spark.createDataFrame([("a", "Â§ 4 of the bidderâ€™s"), ("a", "Â§ 4 of the bidderâ€™s"), ("b", "na�ve"), ("c", None), ("d", "fine"), ("e", "")], "k string, t string").withColumn("restored", F.lit("clash"))
    got = {r["k"]: r["restored_md5"] for r in encoding.repair_encoding(df, "k", "t").collect()}
    assert got == {"a": hashlib.md5("§ 4 of the bidder’s".encode()).hexdigest(), "b": ""}


# p5
def test_repeated_lines(spark):
    rows = []
    for i in range(60):
        body = f"The {chr(97 + i % 26)}{chr(97 + i // 26)}oak item stays with {chr(122 - i % 26)}elm."
        extra = {0: "• Back to Top of page.", 1: f"Updated 0{1 + i % 9}/02/2024 by {['Stores Desk', 'Web Team', 'Legal Desk'][i % 3]}", 2: "BACK  TO TOP OF PAGE"}[i % 3]
        rows.append((f"c{i}", "src", f"{body}\n{extra}\n"))
    rows += [("c0", "src", rows[0][2]), ("n", None, "Back to top of page"), ("m", "other", None), ("o", "other", "")]
    df = spark.createDataFrame(rows, "k string, s string, t string").withColumn("template", F.lit("clash"))
    got = {(r["k"], r["line_no"]) for r in repeated.repeated_lines(df, "k", "s", "t").collect()}
    assert got == {(f"c{i}", 2) for i in range(60)}
    clean = {r["k"]: r["t"] for r in repeated.without_repeated_lines(df, "k", "s", "t").collect()}
    assert clean["c1"] == rows[1][2].split("\n")[0] + "\n" and clean["m"] is None
    assert repeated.repeated_lines(df.where("false"), "k", "s", "t").count() == 0


def test_slots_that_vary(spark):
    """Names without capitals, in Devanagari, first in the line; a line that differs in an ordinary word of few values is not alike."""
    first, last = ["रमेश", "सीता", "मोहन", "गीता", "अरुण"], ["कुमार", "देवी", "मेहता", "शर्मा"]
    rows = []
    for i in range(100):
        name = f"{first[i % 5]} {last[i // 4 % 4]}"
        line = {0: f"{name} द्वारा अंतिम बार जाँचा गया", 1: f"अद्यतन: {name} (12/03/2024)"}.get(i % 4, f"{'price' if i % 8 < 4 else 'payment'} terms" if i % 10 == 3 else f"body line of {chr(97 + i % 26)}{chr(97 + i // 4)}x kind {chr(97 + i // 7)}{chr(100 + i % 11)}")
        rows.append((f"c{i}", "src", f"The {chr(97 + i % 26)}{chr(97 + i // 26)}oak item stays.\n{line}"))
    df = spark.createDataFrame(rows, "k string, s string, t string")
    got = {r["k"] for r in repeated.repeated_lines(df, "k", "s", "t").collect()}
    assert got == {f"c{i}" for i in range(100) if i % 4 < 2}


def test_hot_and_cold_sources_alike(spark, monkeypatch):
    rows = [(f"{s}{i}", s, f"Body {chr(97 + i % 26)}{chr(97 + i // 26)} of it\nBack to top\nUpdated by {'Legal Desk' if i % 2 else 'Web Team'}") for s in ("a", "b", "c") for i in range(12)]
    df = spark.createDataFrame(rows, "k string, s string, t string")
    hot = {tuple(r) for r in repeated.repeated_lines(df, "k", "s", "t").collect()}
    monkeypatch.setattr(repeated, "HOT", 1e9)
    assert {tuple(r) for r in repeated.repeated_lines(df, "k", "s", "t").collect()} == hot and len(hot) == 72


# p6
def test_suffix_automaton_equals_brute_force():
    rng = random.Random(2)
    text = "".join(rng.choices("abc ", k=300))
    automaton = language.SuffixAutomaton(text)
    for _ in range(60):
        z = "".join(rng.choices("abcd ", k=25))
        n, i = 1, 0
        start = 0
        while i < len(z):
            if z[start : i + 1] in text:
                i += 1
                continue
            n += 1
            start = i if z[i] in text else i + 1
            i += 1
        assert automaton.phrases(z) == n


@pytest.mark.parametrize(("text", "langs"), [("Who approves the purchase order?", ["en"]), ("बैंक गारंटी की प्रक्रिया क्या है? Who approves it above the limit?", ["hi", "en"]), ("portal par kaise jama kare?\nQuelle est la procédure ?", ["hi-Latn", "fr"]), ("জামানতের টাকা / EMD की प्रक्रिया क्या है?", ["bn", "hi"])])
def test_segments(parser, text, langs):
    assert [x[1] for x in language.segments(text, parser)] == langs


@pytest.mark.parametrize(("label", "code"), [("en-IN", "en"), ("Hinglish", "hi-Latn"), ("HI_LATN", "hi-Latn"), ("हिन्दी", "hi"), ("zxx", None), (" ", None), (None, None), ("mul", None)])
def test_labels(spark, label, code):
    assert language.label_code(label) == code
    assert spark.createDataFrame([(label,)], "l string").select(language.label_column(F.col("l")).alias("c")).first()["c"] == code


def test_label_languages_odd_rows(spark):
    rows = [("a", None, None, False), ("b", " ", None, False), (None, "x", None, False), ("c", "Who approves it?", "en", True), ("d", "Who approves it?", "hi", True), ("d", "Who approves it?", "hi", True)]
    df = spark.createDataFrame(rows, "record_id string, text string, label string, labelled boolean")
    assert [(r["record_id"], r["segment_no"], r["language"]) for r in language.label_languages(df, SAMPLE).collect()] == [("d", 1, "en")]


# p7
def test_differencing_is_whole_and_even():
    rng = random.Random(4)
    for n, k in itertools.product((0, 1, 5, 40, 300), (1, 3, 17)):
        sizes = [rng.randint(0, 90) for _ in range(n)]
        windows = packing.difference(sizes, k)
        assert sorted(i for _, items in windows for i in items) == list(range(n))
        assert all(size == sum(sizes[i] for i in items) for size, items in windows) and len(windows) <= k
        if n == 300:
            assert max(s for s, _ in windows) - min(s for s, _ in windows) <= 20


def test_fill_needs_no_more_windows_than_raising_one_by_one():
    rng = random.Random(9)
    for draw in (lambda: rng.randint(1, 100), lambda: rng.choice([5, 60, 99]), lambda: min(100, int(rng.paretovariate(1.1) * 4))):
        for _ in range(25):
            sizes = [draw() for _ in range(rng.randint(1, 120))]
            k = -(-sum(sizes) // 100)
            while packing.difference(sizes, k)[0][0] > 100:
                k += 1
            assert len(packing.fill(sizes, 100)) <= k


def test_pack(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([0, 10, 300, 1500, 5000])) for i in range(500)] + [(None, 5), (900, None)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long").withColumn("window_name", F.lit("clash"))
    windows = spark.createDataFrame([("a", 1024), ("b", 4096), ("bad", 0)], "window_name string, capacity_tokens int")
    got = packing.pack(df, windows, "doc_id", block=100).collect()
    for name, capacity in (("a", 1024), ("b", 4096)):
        mine = [r for r in got if r["window_name"] == name]
        used: dict = {}
        for r in mine:
            used[r["container_id"]] = used.get(r["container_id"], 0) + r["tokens"]
        assert max(used.values()) <= capacity
        for i, size in rows[:500]:
            parts = [r["tokens"] for r in mine if r["doc_id"] == i]
            assert sum(parts) == size and len(parts) == max(1, -(-size // capacity) if size > capacity else 1)
        assert sum(used.values()) / (len(used) * capacity) > 0.85
    assert packing.pack(df.where("false"), windows, "doc_id").count() == 0


# p8
def test_flight_balances():
    rng = np.random.default_rng(1)
    sizes = rng.integers(10, 900, 2000).astype(float)
    p = np.full(2000, 0.37)
    q = mixing.flight(p, sizes, rng)
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert abs(q.sum() - p.sum()) < 1e-6 and abs((q * sizes).sum() - (p * sizes).sum()) < 1e-3


def test_landing_keeps_inclusion_probabilities():
    sizes = np.array([500.0, 90.0, 40.0, 30.0, 10.0, 7.0])
    p = np.array([0.3, 0.3, 0.3, 0.3, 0.3, 0.3])
    rng = np.random.default_rng(3)
    drawn = np.mean([mixing.land(mixing.flight(p, sizes, rng), rng) for _ in range(6000)], axis=0)
    assert np.abs(drawn - p).max() < 0.03


def test_no_document_is_lost_to_rounding(spark):
    assert set(mixing.land(mixing.flight(np.array([1e-10, 1 - 1e-10, 1e-10]), np.ones(3), np.random.default_rng(1)), np.random.default_rng(1))) <= {0.0, 1.0}
    df = spark.createDataFrame([(i, s, 10) for i, s in enumerate("aaabbb")], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.1 + 0.2, 3), ("b", 0.3, 3)], "source string, target_share double, max_repeats int")
    assert mixing.mix(df, targets, "doc_id").count() == 6


def test_mix(spark):
    rng = random.Random(8)
    rows = [(i, "big" if i < 3000 else "mid" if i < 3400 else "small" if i < 3440 else "none", rng.randint(20, 900)) for i in range(3500)] + [(None, "big", 5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens long").withColumn("copies", F.lit("clash"))
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 3), ("absent", 0.1, 2), ("odd", None, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(df, targets, "doc_id", block=200)
    assert mixed.count() == 3440
    most = {"big": 1, "mid": 2, "small": 3}
    by: dict = {}
    for r in mixed.collect():
        assert 0 <= r["copies"] <= most[r["source"]]
        by[r["source"]] = by.get(r["source"], 0) + r["copies"] * r["tokens"]
    total = sum(by.values())
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(by[s] / total - share) < 0.01
    assert mixing.mix_report(mixed, targets).count() == 5
    assert mixing.mix(df.where("false"), targets, "doc_id").count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None)], "k int, t string")
    assert {r["k"]: r["tokens"] for r in tokens.with_tokens(df, "t", ["k"]).collect()} == {1: len(tokens.encoding(tokens.VOCABULARY).encode_ordinary("hello world")), 2: 0}


# p9
TEXT = (
    "Name: Girvan Solvanti, I, BALRAM DHURIYAL, request it. Whether DHURIYAL, Balram may sign. Dear Girvan Solvanti, your letter. Write to g.solvanti (at) nilgai (dot) example or a_b9@x.test. "
    "Ring +91-5830859240 or 52 09 92 14 29. PAN XPYZY1599Y, Aadhaar 1907-2537-1027. Bid reference 5919444027, tender number 202136578222. "
    "Sent to Plot 368 Old Canal Road, Sector 7, Rangbeda 054 143 today. Work on Solvanti Bridge. Rs. 5,250,000 paid."
)


def parts_in(*texts, contexts=frozenset()):
    return {p for t in texts for a, b in personal.introduced_names(t, contexts) for p in personal.parts_of(t[a:b])}


def test_items():
    got = {(k, TEXT[a:b]) for a, b, k in personal.find_items(TEXT, parts_in(TEXT))}
    assert got == {
        ("person_name", "Girvan Solvanti"), ("person_name", "BALRAM DHURIYAL"), ("person_name", "DHURIYAL, Balram"), ("email", "g.solvanti (at) nilgai (dot) example"), ("email", "a_b9@x.test"), ("phone", "+91-5830859240"), ("phone", "52 09 92 14 29"),
        ("identity_number", "XPYZY1599Y"), ("identity_number", "1907-2537-1027"), ("street_address", "Plot 368 Old Canal Road, Sector 7, Rangbeda 054 143"),
    }


def test_titles_introduce_names_but_not_places():
    text = "Mr. John Smith met Dr. Meera Iyer. Yours, Shri Arun Mehta. It is on Dr. Ambedkar Marg, near Shri Ram Traders. Smt. SITA DEVI came."
    assert [text[a:b] for a, b in sorted(personal.introduced_names(text, set()))] == ["John Smith", "Meera Iyer", "Arun Mehta", "SITA DEVI"]


def test_contexts_are_learned(spark):
    names = [f"{a}{b} {c}" for a in ("Giran", "Balra", "Sohan") for b in ("m", "n", "k") for c in ("Solvant", "Dhuriyal", "Torsane")]
    rows = [(i, f"Shri {n} came. Since {n} is on leave, wait. The Old Office is on {i}.") for i, n in enumerate(names)] + [(100, "Since Priya Sharma is on leave, wait. Then Priya Sharma left."), (101, "Since Priya Sharma is on leave, stay.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    contexts = personal.learned_contexts(df, "text", len(rows))
    assert "since is" in contexts and not any(c.startswith("the ") for c in contexts)
    got = {r["found_text"] for r in personal.personal_items(df.where("doc_id >= 100"), "doc_id", "text", "k").collect()}
    assert got == set()  # nothing to learn from
    got = {r["found_text"] for r in personal.personal_items(df, "doc_id", "text", "k").where("doc_id >= 100").collect()}
    assert got == {"Priya Sharma"}


def surrogates(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["surrogates"] for r in personal.redact(df, "doc_id", "text", "k").orderBy("doc_id").collect()], [r["placeholders"] for r in personal.redact(df, "doc_id", "text", "k").orderBy("doc_id").collect()]


def test_an_entity_has_one_surrogate_over_all_texts(spark):
    texts = ["Smt. Sita Devi signs. SITA DEVI came.", "Dear Sita Devi, come. Then Smt. Sita Devi left.", "Call 9876543210 or 09876543210 now.", "Shri Ramesh Kumar came. Kumar left. Kumar Bridge stands."]
    (one, two, phones, single), marked = surrogates(spark, *texts)
    name = one.split(" signs")[0].removeprefix("Smt. ")
    assert name.upper() in one and two == f"Dear {name}, come. Then Smt. {name} left." and name[-1] in "ai" and name != "Sita Devi"
    a, b = phones.removeprefix("Call ").removesuffix(" now.").split(" or ")
    assert b == "0" + a and a[0] in "6789" and a != "9876543210"
    given, family = single.split(" came")[0].removeprefix("Shri ").split()
    assert single == f"Shri {given} {family} came. {family} left. Kumar Bridge stands." and family[-1] not in "aeiou"
    assert marked == ["Smt. [PERSON_NAME_1] signs. [PERSON_NAME_1] came.", "Dear [PERSON_NAME_1], come. Then Smt. [PERSON_NAME_1] left.", "Call [PHONE_1] or [PHONE_1] now.", "Shri [PERSON_NAME_1] came. [PERSON_NAME_1] left. Kumar Bridge stands."]


def test_surrogates_do_not_collide(spark):
    """Two-letter names collide for certain; all are distinct in the end and none is an entity."""
    entities = [("person_name", f"{a}{b} {c}{d}") for a in "bcdg" for b in "ae" for c in "klmn" for d in "io"] + [("email", f"{a}{b}@x.test") for a in "bcdghjklmnprstv" for b in "aeiou"] + [("email", "fa@x.test"), ("email", "wi@x.test")]
    df = spark.createDataFrame([(k, e, "", i) for i, (k, e) in enumerate(entities)], "kind string, entity string, gender string, n int")
    drawn = personal.entity_surrogates(df, "k").collect()
    assert len({(r["kind"], r["surrogate"]) for r in drawn}) == len(entities) and not {r["surrogate"] for r in drawn} & {e for _, e in entities}
    assert {r["surrogate"] for r in drawn} != {r["surrogate"] for r in personal.entity_surrogates(df, "other").collect()}


@pytest.mark.parametrize(("kind", "found"), [("phone", "+91-5830859240"), ("phone", "०९८७६ ५४३२१"), ("identity_number", "XPYZY 1599Y"), ("email", "g.solvanti (at) nilgai (dot) example"), ("person_name", "DHURIYAL, Balram K."), ("person_name", "नंदकेश कानवेरकर"), ("street_address", "Plot 368 Old Canal Road, Sector 7, Rangbeda 054 143")])
def test_surrogates_keep_format(kind, found):
    entity = personal.entity_of(kind, found)
    new = personal.dressed(kind, found, entity, personal.replacement(kind, entity, "", b"k", 0))
    assert len(new) == len(found) and new != found
    same = lambda a, b: (a.isdigit(), a.isupper(), a.islower(), a.isascii()) == (b.isdigit(), b.isupper(), b.islower(), b.isascii())
    assert all(same(a, b) for a, b in zip(found, new))
    assert kind != "email" or new.endswith("nilgai (dot) example")


def test_parts_beyond_the_limit_are_joined(spark, monkeypatch):
    df = spark.createDataFrame([(1, TEXT), (2, "balram dhuriyal ne kaha. Dear Girvan Solvanti, come."), (3, "Smt. रमा देवी"), (4, "")], "doc_id long, text string")
    sent = {tuple(r) for r in personal.personal_items(df, "doc_id", "text", "k").collect()}
    monkeypatch.setattr(personal, "PARTS_SENT", 0)
    assert {tuple(r) for r in personal.personal_items(df, "doc_id", "text", "k").collect()} == sent and len(sent) > 10


def test_contexts_are_learned_from_all_texts(spark):
    """Rare contexts in a corpus larger than any draw of it, whose names mostly stand elsewhere."""
    names = [f"{a} {b}" for a in ("Giram", "Balran", "Sohak") for b in ("Solvant", "Dhuriyal", "Torsane")]
    common = spark.range(60_000).select("id", F.concat(F.lit("Shri "), F.element_at(F.array(*map(F.lit, names)), (F.col("id") % 9 + 1).cast("int")), F.lit(" came "), F.col("id")).alias("text"))
    rare = [(60_000 + i, f"Since {n} is on leave, wait {i}.") for i, n in enumerate(names)] + [(60_009, "Since Priya Sharma is on leave, wait.")] + [(60_010 + i, f"Whether {n} may sign {i}.") for i, n in enumerate(names[:5])] + [(60_020 + i, f"Until {n} can sign {i}.") for i, n in enumerate(names[:4])]
    df = common.unionByName(spark.createDataFrame(rare, "id long, text string")).repartition(8)
    assert personal.learned_contexts(df, "text", 60_019) == {"shri came", "since is", "whether may"}
    got = {r["found_text"] for r in personal.personal_items(df, "id", "text", "k").where("id >= 60000").collect()}
    assert got == {*names, "Priya Sharma"}


def test_counted_names_give_what_texts_give_one_by_one(spark, sf):
    """A name that a title and a context introduce at once counts once."""
    more = [f"Shri {a} {b} came. Since {a} {b} is on leave, wait. Since Sohak {b} is on leave, wait. Since {a} Prof is here." for a in ("Giram", "Balran", "Sohak") for b in ("Solvant", "Dhuriyal", "Torsane")] + ["Since Priya Nokt is on leave, stay. Shri Timan Gulv came."]
    df = spark.read.parquet(f"{sf}/documents.parquet").select("text").unionByName(spark.createDataFrame([(t,) for t in more], "text string"))
    contexts = personal.learned_contexts(df, "text", 0)
    seen = Counter(p for r in df.where("text is not null").collect() for a, b in set(personal.introduced_names(r["text"], contexts)) for p in personal.parts_of(r["text"][a:b]))
    counted = personal.counted_names(df, "text")
    parts = {r["part"] for r in personal.name_parts(counted, personal.name_contexts(counted)).collect()}
    assert contexts >= {"since is", "shri came"} and parts == {p for p, n in seen.items() if n >= 2} and seen["nokt"] == seen["gulv"] == 1


def test_contexts_beyond_the_limit_are_joined(spark, monkeypatch):
    names = [f"{a} {b}" for a in ("Giram", "Balran", "Sohak") for b in ("Solvant", "Dhuriyal", "Torsane")]
    df = spark.createDataFrame([(i, f"Shri {n} came. Since {n} is on leave, wait. Then since {n} is here, go.") for i, n in enumerate(names)] + [(9, "Since Priya Sharma is on leave, stay."), (9, "Since Priya Sharma is on leave, stay."), (10, "No name."), (11, "")], "doc_id long, text string")
    items = lambda: sorted(tuple(r) for r in personal.personal_items(df, "doc_id", "text", "k").collect())
    sent = items()
    assert "Priya Sharma" in {found for _, _, found, _ in sent}
    monkeypatch.setattr(personal, "CONTEXTS_SENT", 0)
    assert items() == sent
    monkeypatch.setattr(personal, "PARTS_SENT", 0)
    assert items() == sent


def test_personal_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "write to a_b9@x.test"), (3, "write to a_b9@x.test, a_b9@x.test"), (3, "write to a_b9@x.test, a_b9@x.test")], "doc_id long, text string").withColumn("kind", F.lit("clash"))
    assert sorted((str(r["doc_id"]), r["kind"], r["found_text"]) for r in personal.personal_items(df, "doc_id", "text", "k").collect()) == [("3", "email", "a_b9@x.test"), ("None", "email", "a_b9@x.test")]
    assert personal.redact(df, "doc_id", "text", "k").count() == 4
    assert personal.personal_items(df.where("false"), "doc_id", "text", "k").count() == 0
