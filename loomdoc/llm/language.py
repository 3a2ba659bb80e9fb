"""Problem 6: language of documents and of the segments of mixed ones, and the language models that problem 1 shares.

Cross-parsing: the labelled text of each language becomes a suffix automaton; a sentence is parsed into
longest matches with each, and the language that needs fewest normalised phrases wins. The labelled rows
are a bounded sample that character n-gram naive Bayes has cleaned of wrong labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANGUAGES = ("en", "hi", "hi-Latn", "mr", "bn", "fr")
#: Names that a stored label may give a language, in lower case with "-" for "_".
LABELS = {
    "en": "en", "eng": "en", "english": "en", "अंग्रेज़ी": "en", "hi": "hi", "hin": "hi", "hindi": "hi", "हिन्दी": "hi", "हिंदी": "hi",
    "hi-latn": "hi-Latn", "hin-latn": "hi-Latn", "hinglish": "hi-Latn", "hindi-latin": "hi-Latn", "roman hindi": "hi-Latn", "hi-rom": "hi-Latn",
    "mr": "mr", "mar": "mr", "marathi": "mr", "मराठी": "mr", "bn": "bn", "ben": "bn", "bengali": "bn", "bangla": "bn", "বাংলা": "bn",
    "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr", "français": "fr", "francais": "fr",
}
#: Labelled rows per language that the models are fitted on, drawn in parts by hash: the rank in a part is limited before the shuffle.
SAMPLE_ROWS, PARTS = 1500, 4
#: Words after whose full stop a sentence goes on.
ABBREVIATIONS = {"rs", "no", "nos", "m/s", "mr", "mrs", "ms", "dr", "smt", "shri", "sh", "km", "pg", "p", "viz", "e.g", "i.e", "रु", "क्र", "सं", "डॉ", "art", "st", "sec", "cl", "q", "a", "ans"}
_BENGALI, _DEVANAGARI = re.compile("[ঀ-৿]"), re.compile("[ऀ-ॿ]")
_LETTER = re.compile(r"[^\W\d_]")
_INDIC = re.compile("[ऀ-৿]")


def label_code(label: str | None) -> str | None:
    """The language that a stored label names, whatever its spelling."""
    if label is None:
        return None
    x = label.strip().lower().replace("_", "-")
    if x in LABELS:
        return LABELS[x]
    head, _, tail = x.partition("-")
    return LABELS.get(head) if head in LABELS and len(tail) in (2, 3) else None


def label_column(label: Column) -> Column:
    x = F.lower(F.replace(F.trim(label), F.lit("_"), F.lit("-")))
    names = F.create_map(*[F.lit(v) for pair in LABELS.items() for v in pair])
    head = F.regexp_extract(x, r"^(\p{L}+)-\p{L}{2,3}$", 1)
    return F.coalesce(F.try_element_at(names, x), F.try_element_at(names, head))


def plain(text: str) -> str:
    return re.sub(r"[^\wऀ-෿'’]+", " ", re.sub(r"\d+", "0", text.lower())).strip()


def script_languages(text: str) -> tuple[str, ...]:
    """Languages that the letters of a text allow; borrowed Latin words do not count beside an Indic script."""
    bengali, devanagari, letters = len(_BENGALI.findall(text)), len(_DEVANAGARI.findall(text)), len(_LETTER.findall(text))
    if bengali > devanagari and bengali * 3 >= letters:
        return ("bn",)
    if devanagari and devanagari * 4 >= letters:
        return ("hi", "mr")
    return ("en", "fr", "hi-Latn")


#: Letters keep their code, all else is a space; combining signs of Indic scripts are letters. Code 1 parts texts.
_FOLD = np.full(0x3000, 32, dtype=np.uint32)
for _c in range(0x3000):
    if chr(_c).isalpha() or 0x900 <= _c < 0xE00 and _c not in (0x964, 0x965) and not chr(_c).isdigit():
        _FOLD[_c] = _c
_FOLD[1] = 1
_SLOTS = 1 << 18
#: Characters that are scored at once.
_SPAN = 200_000
#: Which languages each kind of text may be in: none without letters, else by script.
_ALLOWED = np.array([[0, 0, 0, 0, 0, 0], [0, 0, 0, 0, 1, 0], [0, 1, 0, 1, 0, 0], [1, 0, 1, 0, 0, 1]], dtype=bool)


def codes(texts: list[str]) -> np.ndarray:
    """Folded code points of texts, each between two spaces and after a 1, with one space between words."""
    joined = "".join(f"\x01 {t} " for t in (x.replace("\x01", " ") for x in texts)).lower()
    c = _FOLD[np.minimum(np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32), 0x2FFF)]
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    return c[keep]


class NaiveBayes:
    """Character n-gram naive Bayes: log-probabilities of hashed n-grams, per language. Texts are scored many at a time."""

    def __init__(self, texts: dict[str, list[str]], sizes: tuple[int, ...] = (1, 2, 3), table: np.ndarray | None = None):
        self.sizes = sizes
        self.table = self.fitted(texts) if table is None else table

    def fitted(self, texts: dict[str, list[str]]) -> np.ndarray:
        table = np.zeros((_SLOTS, len(LANGUAGES)), dtype=np.float32)
        for j, lang in enumerate(LANGUAGES):
            counts = np.zeros(_SLOTS)
            for begin in range(0, len(texts.get(lang, ())), 1000):
                c = codes(texts[lang][begin : begin + 1000])
                for slots, _ in self.grams(c, np.cumsum(c == 1) - 1):
                    counts += np.bincount(slots, minlength=_SLOTS)
            table[:, j] = np.log(counts + 0.02) - math.log(counts.sum() + 0.02 * _SLOTS)
        return table

    def grams(self, c: np.ndarray, text_of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each size the slots of the n-grams inside a text, and the text of each."""
        for n in self.sizes:
            h = np.full(max(0, len(c) - n + 1), n, dtype=np.uint32)
            for i in range(n):
                h = h * np.uint32(2654435761) + c[i : len(c) - n + 1 + i]
            inside = (c[: len(h)] != 1) & (text_of[: len(h)] == text_of[n - 1 :])
            yield ((h ^ (h >> np.uint32(15))) % np.uint32(_SLOTS))[inside], text_of[: len(h)][inside]

    def posteriors(self, texts: list[str]) -> list[tuple[str | None, float]]:
        """Per text the language of the greatest posterior among those that its script allows, and that posterior; tempered, since the n-grams overlap. None without letters."""
        out: list[tuple[str | None, float]] = []
        begin = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= _SPAN or i + 1 == len(texts):
                out += self._posteriors(texts[begin : i + 1])
                begin, size = i + 1, 0
        return out

    def _posteriors(self, texts: list[str]) -> list[tuple[str | None, float]]:
        c = codes(texts)
        text_of = np.cumsum(c == 1) - 1
        blocks = c >> 7  # of 128 codes: Devanagari is the 18th, Bengali the 19th
        count = lambda which: np.bincount(text_of[which], minlength=len(texts))
        letters, devanagari, bengali = count(c > 32), count(blocks == 18), count(blocks == 19)
        kind = np.where(letters == 0, 0, np.where((bengali > devanagari) & (bengali * 3 >= letters), 1, np.where((devanagari > 0) & (devanagari * 4 >= letters), 2, 3)))
        score = np.zeros((len(texts), len(LANGUAGES)))
        for slots, owner in self.grams(c, text_of):
            if len(slots):
                first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                score[owner[first]] += np.add.reduceat(self.table[slots], first, axis=0)
        score = np.where(_ALLOWED[kind], score / len(self.sizes), -np.inf)
        score[kind == 0] = 0.0
        best = score.argmax(axis=1)
        p = 1 / np.exp(score - score.max(axis=1, keepdims=True)).sum(axis=1)
        return [(LANGUAGES[j], q) if k else (None, 0.0) for j, q, k in zip(best.tolist(), p.tolist(), kind.tolist())]


class SuffixAutomaton:
    """All substrings of a text, for longest-match parsing."""

    def __init__(self, text: str):
        links, lengths, moves, last = [-1], [0], [{}], 0
        for c in text:
            cur = len(links)
            links.append(0), lengths.append(lengths[last] + 1), moves.append({})
            p = last
            while p >= 0 and c not in moves[p]:
                moves[p][c] = cur
                p = links[p]
            if p >= 0:
                q = moves[p][c]
                if lengths[p] + 1 == lengths[q]:
                    links[cur] = q
                else:
                    clone = len(links)
                    links.append(links[q]), lengths.append(lengths[p] + 1), moves.append(dict(moves[q]))
                    while p >= 0 and moves[p].get(c) == q:
                        moves[p][c] = clone
                        p = links[p]
                    links[q] = links[cur] = clone
            last = cur
        self.moves = moves
        self.bits = math.log2(len(text) + 2)

    def phrases(self, text: str) -> int:
        """Phrases of the greedy parse of a text into longest matches, each ended by the letter that breaks it."""
        n, at, moves = 0, 0, self.moves
        for c in text:
            to = moves[at].get(c)
            if to is None:
                n += 1
                to = moves[0].get(c, 0)
            at = to
        return n + 1


class CrossParser:
    def __init__(self, texts: dict[str, list[str]]):
        self.automata = {lang: SuffixAutomaton("\n".join(f" {plain(t)} " for t in rows)) for lang, rows in texts.items() if rows}
        self.language = lru_cache(maxsize=200_000)(self._language)

    def _language(self, plain_text: str, allowed: tuple[str, ...]) -> tuple[str, float]:
        """The language whose automaton needs the fewest bits of phrases, and how sure that is."""
        cost = sorted((a.phrases(f" {plain_text} ") * a.bits, x) for x in allowed if (a := self.automata.get(x)))
        if not cost:
            return allowed[0], 0.5
        if len(cost) == 1:
            return cost[0][1], 0.99
        return cost[0][1], 1 / (1 + sum(2 ** -min(40.0, (c - cost[0][0]) / 4) for c, _ in cost[1:]))

    def __call__(self, text: str) -> tuple[str, float]:
        return self.language(plain(text), script_languages(text))


_SENTENCE_END = re.compile(r"[.?!।॥…]+[\"'”’)\]]*(?=\s|$)")
_LINE, _LINE_OR_SLASH = re.compile(r"[\r\n]+"), re.compile(r"[\r\n]+|\s+[/|]\s+")


def sentences(text: str) -> list[str]:
    """Whole sentences: cut at ends of sentences, line breaks and spaced slashes or bars."""
    out = []
    for line in (_LINE_OR_SLASH if "/" in text or "|" in text else _LINE).split(text):
        start = 0
        for m in _SENTENCE_END.finditer(line):
            if line[m.start()] == ".":
                head = line[start : m.start()]
                word = head.rsplit(None, 1)[-1].lower().lstrip("(\"'“") if head and not head[-1].isspace() else ""
                if word in ABBREVIATIONS or len(word) == 1 and word.isalpha() or word.isdigit() and m.start() - start <= 3:
                    continue
            out.append(line[start : m.end()])
            start = m.end()
        out.append(line[start:])
    return [s.strip() for s in out if s.strip()]


_UNMARKED = re.compile(r"(?<=[a-zà-ÿ] )(?=[ऀ-ॣ০ঀ-৿0-9A-Z])|(?<=[ऀ-ॣঀ-৿] )(?=[A-Za-z])")


def _parts(sentence: str, parser: CrossParser) -> list[str]:
    """The sentence, or its two halves where the language changes for certain without a mark between."""
    for m in _UNMARKED.finditer(sentence):
        left, right = sentence[: m.start()], sentence[m.start() :]
        if left.count(" ") >= 3 and right.count(" ") >= 2 and not (right[0].isdigit() and _INDIC.search(left + right) is None):
            (a, sure_a), (b, sure_b) = parser(left), parser(right)
            if a != b and min(sure_a, sure_b) > 0.985 and (_INDIC.search(left) is None or _INDIC.search(right) is None):
                return [left.strip(), right]
    return [sentence]


def segments(text: str, parser: CrossParser) -> list[tuple[str, str, float]]:
    """(text, language, confidence) of each longest run of sentences in one language. Sentences without a word join the run before or after."""
    runs: list[list] = []
    for s in (part for whole in sentences(text) for part in _parts(whole, parser)):
        lang, sure = parser(s) if len(_LETTER.findall(s)) > 2 else (None, 1.0)
        if runs and (lang is None or runs[-1][1] in (lang, None)):
            runs[-1][0] += " " + s
            runs[-1][1] = runs[-1][1] or lang
            runs[-1][2] = min(runs[-1][2], sure)
        else:
            runs.append([s, lang, sure])
    return [(t, lang or "en", sure) for t, lang, sure in runs]


def labelled_sample(questions: DataFrame, key: str, text: str, label: str, rows: int = SAMPLE_ROWS) -> dict[str, list[str]]:
    """At most ``rows`` labelled texts per language, as many from each of PARTS parts, drawn by hash of the key. Sentences that naive Bayes is sure are in another language count to that one.

    This bounded sample is all that comes to the driver. Nulls in key, text or label are left out.
    """
    part = F.pmod(F.xxhash64(key, F.lit("part")), F.lit(PARTS))
    by = Window.partitionBy("lang", "part").orderBy(F.xxhash64(key), key)
    drawn = (
        questions.select(key, F.col(text).alias("text"), label_column(F.col(label)).alias("lang"), part.alias("part")).where(f"lang is not null and text is not null and {key} is not null")
        .withColumn("n", F.row_number().over(by)).where(F.col("n") <= rows // PARTS).orderBy("lang", key).select("text", "lang").collect()
    )
    pairs = [(s, r["lang"]) for r in drawn for s in sentences(r["text"]) if len(_LETTER.findall(s)) > 2]
    kept = [(s, lang) for s, lang in pairs if lang in script_languages(s)]
    for _ in range(3):
        model = NaiveBayes({x: [t for t, lang in kept if lang == x] for x in LANGUAGES})
        kept = [(t, best) for (t, lang), (best, p) in zip(pairs, model.posteriors([t for t, _ in pairs])) if best and (best == lang or p > 0.999)]
    # a sentence no part of which is in another language for certain
    halves = [(i, lang, " ".join(part)) for i, (t, lang) in enumerate(kept) for w in [t.split()] for part in (w[: len(w) // 2], w[len(w) // 2 :], w[:5], w[-5:]) if len(part) >= 3]
    mixed = {i for (i, lang, _), (best, p) in zip(halves, model.posteriors([t for _, _, t in halves])) if best and best != lang and p >= 0.995}
    return {x: [t for i, (t, lang) in enumerate(kept) if lang == x and i not in mixed] for x in LANGUAGES}


def label_languages(records: DataFrame, sample: dict[str, list[str]]) -> DataFrame:
    """(record_id, segment_no, language, confidence, text) of (record_id, text[, label, labelled]).

    Where ``labelled`` is true, the record comes out only if its label names no language or not that of all
    its text. Null and blank texts give no row; a record that comes again counts once; empty tables give none.
    """
    shared = records.sparkSession.sparkContext.broadcast(sample)  # at most SAMPLE_ROWS texts per language
    held: list[CrossParser] = []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = held[0] if held else CrossParser(shared.value)
        held.append(parser)
        for batch in batches:
            rows = []
            for key, text, label, labelled in zip(batch["record_id"], batch["text"], batch["label"], batch["labelled"]):
                found = segments(text, parser)
                if labelled and len(found) == 1 and label_code(label) == found[0][1]:
                    continue
                rows += [(key, i, lang, round(sure, 4), t) for i, (t, lang, sure) in enumerate(found, 1)]
            yield pd.DataFrame(rows, columns=["record_id", "segment_no", "language", "confidence", "text"])

    found = records.where(r"record_id is not null and text rlike '\\p{L}'").select("record_id", "text", "label", "labelled").mapInPandas(run, "record_id string, segment_no int, language string, confidence double, text string")
    return found.groupBy("record_id", "segment_no").agg(F.min_by("language", "text").alias("language"), F.min_by("confidence", "text").alias("confidence"), F.min("text").alias("text"))
