"""Problem 9: personal information inside free text.

Surrogate generation. Contacts, numbers and addresses are found by their form; names by titles, by general
cues, by contexts learned from the corpus, and by the name parts that these give over all rows. Mentions are
gathered into entities over the whole corpus, each entity receives one keyed replacement of the same kind,
script, gender and format, and entities whose replacements collide draw again until all are distinct.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdoc.operators.ranking import spread_join
from loomdoc.session import cut

KINDS = ("email", "phone", "identity_number", "street_address", "person_name")
_D = "[0-9०-९]"
_LOCAL = r"[A-Za-z0-9](?:[\w.+-]*[A-Za-z0-9])?"
_EMAIL = re.compile(
    rf"(?<![\w.+-]){_LOCAL}(?: ?[@＠] ?| ?[\[({{]\s?at\s?[\])}}] ?)[A-Za-z0-9-]+(?:(?:\.| ?[\[({{]\s?dot\s?[\])}}] ?| dot )[A-Za-z0-9-]+)+"
    rf"|(?<![\w.+-]){_LOCAL} at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+", re.I)  # fmt: skip
_IDENTITY = re.compile(
    rf"(?<![\w/.,-])(?:{_D}{{4}}([ .-]?){_D}{{4}}\1{_D}{{4}}(?:\1{_D}{{4}})?|[A-Za-z]{{5}}[ -]?{_D}{{4}}[ -]?[A-Za-z]|[A-Za-z]{{3}}[ -]?{_D}{{7}}|[A-Za-z]{{2}}/{_D}{{2}}/{_D}{{3}}/{_D}{{6}})(?![\w/]|[.,-]{_D})")
_PHONE = re.compile(
    rf"(?<![\w/.,+-])(?:(?:\+ ?91|\+ ?९१|0091|००९१)[-. ]?)?(?:\({_D}{{3,5}}\)[- ]?{_D}{{3}}[- ]?{_D}{{4}}|{_D}{{5}}[- ]{_D}{{5}}|{_D}{{2}}(?: {_D}{{2}}){{4}}|{_D}{{3,4}}[-. ]{_D}{{3}}[-. ]{_D}{{3,4}}|[0०]{_D}{{2,4}}-{_D}{{6,8}}|[0०]?{_D}{{10}})(?![\w/]|[.,-]{_D})")
#: Words before a number that make it one of a tender, bid, lot, file, invoice or article.
_OTHER_NUMBER = re.compile(
    r"(?:tender|bid|lot|file|invoice|bill|notice|reference|ref|item|catalogue|order|batch|serial|folio|receipt|rfq|challan|chainage|clause|rule|संदर्भ|निविदा|पत्र|बोली|चालान|आदेश|फ़ाइल|फाइल|बीजक|लॉट)(?: (?:number|no|id|notice|reference|ref|क्रमांक|संख्या|सं))?[.:# ]*$", re.I)
_STREET = r"(?:Street|Road|Rd|Lane|Avenue|Marg|Galli|Gali|Path|Chowk|Para|Bazaar|Crescent|Close|Drive|Way|Terrace|Salai)"
_ROMAN = r"(?:[IVX]+|\d{1,3}|[A-Z])"
_PIN = rf"(?:(?:,? ?(?:PIN|Pin|पिन)(?: ?[:-])? ?|,? ?[-–] ?|,? ){_D}{{3}} ?{_D}{{3}}(?!{_D}))?"
_ADDRESS = re.compile(
    rf"(?<![\w/#])(?:(?:Plot|Flat|House|H\.? ?No\.?|Qtr\.?|Quarter|Door|Shop|Block|Room|D\.? ?No\.?)(?: ?(?:No\.?|Number))?,? ?)?#?\d+[A-Z]?(?:[-/]\d+[A-Z]?)?,? (?:(?:Block|Floor|Tower|Wing) [\dA-Z]+,? )?"
    rf"(?:[A-Z][\w'’]* ){{1,3}}?{_STREET}\b(?: No\.? ?\d+)?(?:,? (?:[A-Z][\w'’]*(?: [A-Z][\w'’]*)?(?: {_ROMAN})?),(?= [A-Z])){{0,2}},? [A-Z][a-z]+{_PIN}"
    rf"|(?:प्लॉट|क्वार्टर|मकान|फ्लैट|फ़्लैट|म\.|भूखंड|घर)(?: ?(?:नं\.?|नंबर|संख्या|क्रमांक|सं\.?))? ?{_D}+[A-Zअ-ह]?(?:[-/]{_D}+)?,? (?:[ऀ-ॣ]+ ?){{1,4}}(?:, ?[ऀ-ॣ]+(?: (?:[ऀ-ॣ]+|{_D}+))?(?=,))?, ?[ऀ-ॣ]+{_PIN}")  # fmt: skip
#: General cues that introduce a person; N is the name.
_CUES = (
    "Name: N", "I, N, request", "I, N, hereby", "Dear N,", "contact N", "cc: N", "signed by N", "My name is N", "mera naam N hai", "N ji ko", "N, residing at",
    "नाम: N", "मेरा नाम N है",
)
_TITLE = r"(?:(?:Shri|Smt|Sri|Dr|Er|Mr|Mrs|Ms|Km|Prof|Adv|SHRI|SMT|DR|MR|MRS|MS|shri|smt|dr|श्रीमती|श्री|डॉ|कु|सुश्री|इंजी)\.? )"
TITLES = {"shri", "smt", "sri", "dr", "er", "mr", "ms", "km", "mrs", "prof", "adv", "श्री", "श्रीमती", "डॉ", "सुश्री", "इंजी", "the", "and", "for", "dear", "name", "hai", "aur", "से", "का", "ने"}
_PART = r"[A-Z][a-z]{2,}|[A-Z]{3,}|[a-z]{3,}"
_FULL = rf"(?:(?:{_PART}), (?:{_PART})|(?:{_PART})(?: [A-Z]\.){{0,2}} (?:{_PART}))"
_INDIC_FULL = r"[ऀ-ॣ]+(?: [ऀ-ॣ]+)"
#: Two words in capitals, which learned contexts are counted of.
_CAPITALS = re.compile(r"[A-Z](?:[a-z]{2,}(?: [A-Z]\.){0,2} [A-Z][a-z]{2,}|[A-Z]{2,}(?:(?: [A-Z]\.){0,2} [A-Z]{3,}|, [A-Z][a-z]{2,}))(?![\w@])")
#: A context is one of names if at least this share of its capitalised pairs are known names, and if they are at least so many, at any size of the corpus.
SURE, LEAST = 0.9, 5
#: Up to so many name parts and contexts are sent to the tasks; more are joined to the words and contexts of each text.
PARTS_SENT, CONTEXTS_SENT = 200_000, 200_000
#: Share of all texts above which an entity is hot.
HOT = 0.001


def _cue(cue: str) -> tuple[str, re.Pattern]:
    """The longest literal part of a cue, to look for first, and its pattern."""
    before, after = cue.split("N", 1) if not cue.startswith("Name") else ("Name: ", "")
    name = _INDIC_FULL if re.search("[ऀ-ॿ]", cue) else _FULL
    return max((before, after), key=len), re.compile((r"\b" if not before else re.escape(before)) + f"{_TITLE}?({name})" + re.escape(after))


_CUE_PATTERNS = [_cue(c) for c in _CUES]
_TITLED = re.compile(rf"{_TITLE}({_FULL}|{_INDIC_FULL})")
_PLACES = r"(?:Traders|Street|Road|Lane|Avenue|Marg|Galli|Gali|Nagar|Bridge|Pvt|Ltd|Enterprises|Industries|Colony|Works|Sons|Brothers|Infra|Chowk|Para|Path|ट्रेडर्स|मार्ग|गली|नगर|रोड|चौक|पुल|सेतु|एंड|उद्योग)"
_NOT_PERSON = re.compile(rf"^,? ?{_PLACES}")
_ENDS_IN_PLACE = re.compile(rf"[ ,]{_PLACES}$")
#: Left of a pair: the start of a text, a line or a sentence.
_SAYS_NOTHING = frozenset(".?!^\n")
_LEFT, _RIGHT = re.compile(r"(\w+|[^\w\s]|\n)[ \t]*\Z"), re.compile(r"[ \t]*(\w+|[^\w\s]|\n)")


def number_is_other(text: str, start: int) -> bool:
    return _OTHER_NUMBER.search(text[max(0, start - 40) : start]) is not None


def context_of(text: str, start: int, end: int) -> str:
    """The word or mark before a span and the one after it, in lower case."""
    left, right = _LEFT.search(text[max(0, start - 40) : start]), _RIGHT.match(text[end : end + 40])
    return " ".join("0" if x[0].isdigit() else x.lower() for x in (left[1] if left else "^", right[1] if right else "$"))


def _stands_free(text: str, start: int) -> bool:
    """Whether no word goes on at a place; looked up after a match, for patterns that begin with letters are found quicker."""
    return not start or not (text[start - 1].isalnum() or text[start - 1] in "_@.")


def capital_pairs(text: str) -> Iterator[re.Match]:
    """Two capitalised words side by side, every such pair of a longer run; no title is one of them."""
    at = 0
    while m := _CAPITALS.search(text, at):
        first = m[0].partition(" ")[0].rstrip(",")
        if _stands_free(text, m.start()) and first.lower() not in TITLES:
            yield m
        at = m.start() + len(first)


@lru_cache(maxsize=4)
def _lefts(contexts: frozenset[str]) -> set[str]:
    return {c.partition(" ")[0] for c in contexts}


def _left_word(text: str, start: int) -> str:
    """The word or mark before a place, as context_of has it, but without a search: most contexts are told by it not to be learned ones."""
    stop = start
    while stop and text[stop - 1] in " \t":
        stop -= 1
    if not stop:
        return "^"
    begin = stop - 1
    if not (text[begin].isalnum() or text[begin] == "_"):
        return text[begin]
    while begin and (text[begin - 1].isalnum() or text[begin - 1] == "_"):
        begin -= 1
    return "0" if text[begin].isdigit() else text[begin:stop].lower()


def introduced_names(text: str, contexts: set[str]) -> Iterator[tuple[int, int]]:
    """Spans of names after a title, with a general cue or in a learned context; not of places and firms named after someone."""
    spans = [m.span(1) for m in _TITLED.finditer(text) if _stands_free(text, m.start())]
    spans += [m.span(1) for literal, pattern in _CUE_PATTERNS if literal in text for m in pattern.finditer(text)]
    if contexts:
        lefts = _lefts(frozenset(contexts))
        spans += [m.span() for m in capital_pairs(text) if _left_word(text, m.start()) in lefts and context_of(text, *m.span()) in contexts]
    for start, end in spans:
        if not text[start:end].islower() and not _NOT_PERSON.match(text[end : end + 14]) and not _ENDS_IN_PLACE.search(text[start:end]):
            yield start, end


def parts_of(name: str) -> list[str]:
    return [p for p in re.findall(r"(?:[^\W\d_]|[ऀ-ॣ]){3,}", name.lower()) if p not in TITLES]


_WORD = re.compile(r"(?:\w|[ऀ-ॣ])+")


def lowered(text: str) -> str:
    """The text in lower case, letter by letter, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def known_words(text: str, known: set[str] | ahocorasick.Automaton) -> list[tuple[int, int]]:
    """Spans of the whole words of a text that are known, from a set or, quicker, an automaton of them."""
    if not known:
        return []
    low = lowered(text)
    if isinstance(known, set):
        return [m.span() for m in _WORD.finditer(low) if m[0] in known]
    out = []
    for end, size in known.iter(low):
        start, stop = end - size + 1, end + 1
        if not (start and _WORD.match(low[start - 1])) and not (stop < len(low) and _WORD.match(low[stop])):
            out.append((start, stop))
    return out


def automaton_of(parts: set[str]) -> ahocorasick.Automaton | set[str]:
    if not parts:
        return parts
    automaton = ahocorasick.Automaton()
    for part in sorted(parts):
        automaton.add_word(part, len(part))
    automaton.make_automaton()
    return automaton


def lexicon_names(text: str, known: set[str] | ahocorasick.Automaton) -> list[tuple[int, int]]:
    """Spans of full names: two known parts, or a known part with initials; a part by itself is no name."""
    hits = known_words(text, known)
    out, i = [], 0
    while i < len(hits):
        start, stop = hits[i]
        i += 1
        if text[start - 1 : start] in {"@", "＠", "+", "_", "."} and text[start - 2 : start - 1] != " " and not re.search(r"\b[A-Z]\.$", text[max(0, start - 3) : start]):
            continue
        before = re.search(r"(?:\b[A-Zअ-ह]\. ?){1,3}$", text[max(0, start - 12) : start])
        first = start - len(before[0]) if before else start
        last, parts = stop, 1 + bool(before)
        middle = re.match(r"(?: [A-Zअ-ह]\.){1,2} ", text[stop : stop + 8])
        gap = len(middle[0]) if middle else 2 if text[stop : stop + 2] == ", " and text[start:stop].isupper() and not before else 1 if text[stop : stop + 1] == " " else 0
        if gap and i < len(hits) and hits[i][0] == stop + gap:
            last, parts = hits[i][1], parts + 1
            i += 1
        elif not before and (tail := re.match(r"(?: [A-Zअ-ह]\.){1,2}(?!\w)", text[stop : stop + 8])):
            last, parts = stop + len(tail[0]), parts + 1
        if parts > 1 and not _NOT_PERSON.match(text[last : last + 14]) and text[last : last + 1] not in {"@", "＠", "+", "_"}:
            out.append((first, last))
    return out


#: Where an address, a number of identity or a phone may be, so that the long patterns are tried there only.
_STREETS = tuple(_STREET[3:-1].split("|"))
_INDIC_HOUSES = ("प्लॉट", "क्वार्टर", "मकान", "फ्लैट", "फ़्लैट", "म.", "भूखंड", "घर")
_LONG_NUMBER, _NUMBER = re.compile(rf"{_D}{{4,}}"), re.compile(rf"{_D}{{2,}}")


def _identity_starts(text: str) -> Iterator[int]:
    """Runs of digits, or what may stand before one in an identity number: three or five letters, or parts with strokes."""
    for m in _LONG_NUMBER.finditer(text):
        at = m.start()
        before = text[at - 1] if at else " "
        if before == "/":
            yield max(0, at - 10)
        elif before.isalpha() or before in " -":
            for k in (6, 5, 4, 3):
                if at >= k and text[at - k].isalpha() and (at == k or not text[at - k - 1].isalnum()):
                    yield at - k
        yield at



def _matches(pattern: re.Pattern, text: str, starts: Iterator[int]) -> Iterator[re.Match]:
    """Matches at given places, in order and without overlap."""
    free = 0
    for at in starts:
        if at >= free and (m := pattern.match(text, at)):
            yield m
            free = m.end()


_AT = re.compile(r"[@＠]|[\[({]\s?at\s?[\])}]| at (?=[A-Za-z0-9-]+ dot )", re.I)


def _email_starts(text: str) -> Iterator[int]:
    """Where the word before an at sign begins."""
    if "@" not in text and "＠" not in text and "dot" not in text.lower():
        return
    for m in _AT.finditer(text):
        at = m.start()
        at -= bool(at) and text[at - 1] == " "
        while at and (text[at - 1].isalnum() or text[at - 1] in "_.+-"):
            at -= 1
        yield at


def _phone_starts(text: str) -> Iterator[int]:
    """Runs of digits, with the sign or bracket before them."""
    for m in _NUMBER.finditer(text):
        at = m.start()
        if at and text[at - 1] in "+(":
            yield at - 1
        elif at > 1 and text[at - 2] == "+" and text[at - 1] == " ":
            yield at - 2
        else:
            yield at


def find_items(text: str, known: set[str] | ahocorasick.Automaton, contexts: set[str] = frozenset()) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each item, in order and without overlap: contacts and numbers come before names."""
    spans: list[tuple[int, int, str]] = []

    def add(start: int, end: int, kind: str) -> None:
        if not any(start < e and s < end for s, e, _ in spans):
            spans.append((start, end, kind))

    for m in _matches(_EMAIL, text, _email_starts(text)):
        add(*m.span(), "email")
    if any(w in text for w in _STREETS) or any(w in text for w in _INDIC_HOUSES):
        for m in _ADDRESS.finditer(text):
            add(*m.span(), "street_address")
    for m in _matches(_IDENTITY, text, iter(sorted(set(_identity_starts(text))))):
        if not number_is_other(text, m.start()) and re.search(_D, m[0]):
            add(*m.span(), "identity_number")
    for m in _matches(_PHONE, text, _phone_starts(text)):
        digits = len(re.findall(_D, m[0]))
        bare = m[0][0] not in "+(" and digits == 10
        if number_is_other(text, m.start()) or bare and m[0][0] in "0०१1234" and not re.search(r"[- ]", m[0]) or digits not in (10, 11, 12, 14):
            continue
        add(*m.span(), "phone")
    for start, end in [*lexicon_names(text, known), *introduced_names(text, contexts)]:
        add(start, end, "person_name")
    return sorted(spans)


def counted_names(df: DataFrame, text: str) -> DataFrame:
    """(context, first, last, pairs, fresh): what contexts and name parts are told by, counted over all rows in one pass.

    With a context: the parts of a capitalised pair, how often it stands there, and how often no title or cue introduces
    it too. With none: a part in ``first`` and how often titles and cues introduce it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs, fresh = Counter(), Counter()
            for t in batch["t"]:
                introduced = set(introduced_names(t, frozenset()))
                fresh.update((None, p, None) for a, b in introduced for p in parts_of(t[a:b]))
                for m in capital_pairs(t):
                    if _left_word(t, m.start()) in _SAYS_NOTHING or _NOT_PERSON.match(t[m.end() : m.end() + 14]):
                        continue
                    context = context_of(t, *m.span())
                    if context[0] in _SAYS_NOTHING or not re.search(r"[^\W\d_]{2}", context):  # marks alone say nothing either
                        continue
                    key = (context, *parts_of(m[0]), None)[:3]
                    pairs[key] += 1
                    fresh[key] += m.span() not in introduced and not _ENDS_IN_PLACE.search(m[0])
            yield pd.DataFrame([(*key, pairs[key], n) for key, n in fresh.items()], columns=["context", "first", "last", "pairs", "fresh"])

    counted = df.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).mapInPandas(run, "context string, first string, last string, pairs long, fresh long")
    return cut(counted.groupBy("context", "first", "last").agg(F.sum("pairs").alias("pairs"), F.sum("fresh").alias("fresh")))


def name_parts(counted: DataFrame, contexts: DataFrame | None = None, least: int = 2) -> DataFrame:
    """(part) of names that titles, cues and ``contexts`` introduce, in lower case; a part must be introduced ``least`` times."""
    parts = counted.where("context is null").select(F.col("first").alias("part"), "fresh")
    if contexts is not None:
        near = counted.where("context is not null and fresh > 0").join(contexts.select("context"), "context", "left_semi")
        parts = parts.unionByName(near.select(F.explode(F.array("first", "last")).alias("part"), "fresh").where("part is not null"))
    return parts.groupBy("part").agg(F.sum("fresh").alias("n")).where(F.col("n") >= least).select("part")


def name_contexts(counted: DataFrame) -> DataFrame:
    """(context, pairs): contexts in which SURE of the capitalised pairs, and LEAST of them, consist of parts that titles and cues give."""
    known = name_parts(counted)
    judged = counted.where("context is not null")
    for c in ("first", "last"):
        judged = judged.join(known.select(F.col("part").alias(c), F.lit(True).alias(f"_{c}")), c, "left")
    name = F.col("_first").isNotNull() & (F.col("last").isNull() | F.col("_last").isNotNull())
    sums = judged.groupBy("context").agg(F.sum("pairs").alias("pairs"), F.sum(F.when(name, F.col("pairs")).otherwise(0)).alias("names"))
    return sums.where((F.col("names") >= SURE * F.col("pairs")) & (F.col("names") >= LEAST)).select("context", "pairs")


def learned_contexts(df: DataFrame, text: str, rows: int | None = None) -> set[str]:
    """The contexts of names of all texts, brought to the driver. All are read, so that ``rows``, their number, does not matter."""
    return {r["context"] for r in name_contexts(counted_names(df, text)).collect()}


def _held_parts(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """(_h, _parts): the name parts that a text holds, at most its words."""
    words = rows.select("_h", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("_t"), F.lit(r"[\p{L}\x{900}-\x{963}]{3,}"), F.lit(0)))).alias("part"))
    return words.join(parts, "part").groupBy("_h").agg(F.collect_set("part").alias("_parts"))


def _held_contexts(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """(_h, _contexts): the contexts of names that a text holds, at most its capitalised pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(h, c) for h, t in zip(batch["_h"], batch["_t"]) for c in {context_of(t, *m.span()) for m in capital_pairs(t)}], columns=["_h", "context"])

    stand = cut(rows.select("_h", "_t").mapInPandas(run, "_h string, context string"))
    total = contexts.agg(F.sum("pairs")).first()[0]
    return spread_join(stand, contexts, ["context"], F.col("pairs") >= HOT * total).groupBy("_h").agg(F.collect_set("context").alias("_contexts"))


_FEMALE, _MALE = re.compile(r"\b(?:smt|mrs|ms|km)\.? ?$|श्रीमती ?$|सुश्री ?$|कु\. ?$", re.I), re.compile(r"\b(?:shri|sri|mr)\.? ?$|श्री ?$", re.I)


def entity_of(kind: str, found: str) -> str:
    """What makes two mentions the same: the parts of a name in any order; the last ten digits of a phone; an address with its signs written out; else letters and digits."""
    low = lowered(found)
    if kind == "person_name":
        return " ".join(sorted(re.findall(r"(?:[^\W\d_]|[ऀ-ॣ])+", low)))
    if kind == "phone":
        return "".join(str(int(c)) for c in found if c.isdigit())[-10:]
    if kind == "email":
        plain = re.sub(r" ?[@＠] ?| ?[\[({]\s?at\s?[\])}] ?| at ", "@", low, count=1)
        return re.sub(r" ?[\[({]\s?dot\s?[\])}] ?| dot ", ".", plain).replace(" ", "")
    words = re.findall(r"(?:[^\W_]|[ऀ-ॣ])+", low)
    return ("" if kind == "identity_number" else " ").join("".join(str(int(c)) if c.isdigit() else c for c in w) for w in words)


#: Letters are replaced within their class, so that words stay readable: vowels, consonants and vowel signs of each script.
_CLASSES = ("aeiou", "bcdghjklmnprstv", "अइउएओ", "कखगघचजटडतदधनपबमरलवसह", "ािीुूेो", "0123456789")
_CLASS_OF = {c: k for k in _CLASSES for c in k} | dict.fromkeys("yfqwxz", _CLASSES[1]) | {c: _CLASSES[3] for c in "ङछझञठढणथफभयशषळ"} | {c: _CLASSES[2] for c in "आईऊऐऔऋ"} | {c: _CLASSES[4] for c in "ैौृ"}
_KEPT_WORDS = re.compile(rf"(?:plot|flat|house|h|qtr|quarter|door|shop|room|block|floor|tower|wing|no|number|pin|sector|phase|ward|{_STREET[3:-1].lower()}|प्लॉट|क्वार्टर|मकान|फ्लैट|फ़्लैट|म|भूखंड|घर|नं|नंबर|संख्या|क्रमांक|सं|मार्ग|गली|रोड|चौक|पारा|पिन|सेक्टर|वार्ड)")


def _stream(key: bytes, *what: str) -> Iterator[int]:
    block = 0
    while True:
        yield from hmac.new(key, "\0".join([*what, str(block)]).encode(), hashlib.sha256).digest()
        block += 1


PATIENCE = 5


def _other_word(word: str, key: bytes, kind: str, attempt: int, gender: str = "") -> str:
    """A word of the same length and script, letter for letter of the same class; its last letter is a vowel in a woman's name and a consonant in a man's.

    After PATIENCE draws words of letters grow by one letter a draw, so that there are enough for any number of short ones.
    """
    stream = _stream(key, kind, word, str(attempt))
    out = ""
    for c in word + (word[-1] * (attempt - PATIENCE) if attempt > PATIENCE and word[-1:].isalpha() and kind in ("person_name", "email", "street_address") else ""):
        of = _CLASS_OF.get(c)
        out += of[next(stream) % len(of)] if of else c
    if gender and len(word) > 1:
        latin = out[-1].isascii()
        if gender == "f":
            out = out[:-1] + (("a", "i")[next(stream) % 2] if latin else "ी" if out[-2] in _CLASSES[3] else "आ")
        elif out[-1] not in _CLASSES[1] + _CLASSES[3]:
            of = _CLASSES[1] if latin else _CLASSES[3]
            out = out[:-1] + of[next(stream) % len(of)]
    return out


def replacement(kind: str, entity: str, gender: str, key: bytes, attempt: int) -> str:
    """The entity that stands for another: word for word, so that single parts of a name and shared streets stay recognisable."""
    word = lambda m: _other_word(m[0], key, kind, attempt, gender if kind == "person_name" else "")
    if kind == "person_name":
        return re.sub(r"(?:[^\W\d_]|[ऀ-ॣ])+", word, entity)
    if kind == "street_address":
        return re.sub(r"(?:[^\W_]|[ऀ-ॣ])+", lambda m: m[0] if _KEPT_WORDS.fullmatch(m[0]) else word(m), entity)
    if kind == "email":
        head, at, tail = entity.partition("@")
        return re.sub(r"[a-z]+|[0-9]+", word, head) + at + tail
    out = _other_word(entity, key, kind, attempt)
    if kind == "phone" and out:  # a number keeps its range: a mobile one begins with 6 to 9, others not with 0
        first = "6789" if entity[0] in "6789" else "2345"
        return first[next(_stream(key, kind, entity, str(attempt), "first")) % 4] + out[1:]
    return out


def dressed(kind: str, found: str, entity: str, new: str) -> str:
    """``new`` as ``found`` writes its entity: order of parts, case, digits of its script, signs and prefix."""
    if kind == "person_name":
        of = dict(zip(re.findall(r"(?:[^\W\d_]|[ऀ-ॣ])+", entity), re.findall(r"(?:[^\W\d_]|[ऀ-ॣ])+", new)))
        return re.sub(r"(?:[^\W\d_]|[ऀ-ॣ])+", lambda m: _cased(m[0], of.get(lowered(m[0]), m[0])), found)
    letters = [c for c in new if c.isalnum() or "ऀ" <= c <= "ॣ"]
    places = [i for i, c in enumerate(found) if c.isalnum() or "ऀ" <= c <= "ॣ"]
    if kind == "email":
        at = re.search(r" ?[@＠] ?| ?[\[({]\s?at\s?[\])}] ?| at ", found, re.I)
        places, letters = [i for i in places if not at or i < at.start()], [c for c in new.partition("@")[0] if c.isalnum()]
    if kind == "phone":
        places = places[-len(letters) :]
    out = list(found)
    if places and len(letters) > len(places):
        out[places[-1]] += "".join(letters[len(places) :])
    for i, c in zip(places, letters):
        rest = out[i][1:]
        out[i] = chr(ord(found[i]) - int(found[i]) + int(c)) if found[i].isdigit() and c.isdigit() else c.upper() if found[i].isupper() else c
        out[i] += rest
    return "".join(out)


def _cased(old: str, new: str) -> str:
    return new.upper() if len(old) > 1 and old.isupper() else new.capitalize() if old[:1].isupper() else new


def _mentions(df: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """(_k, _h, start, stop, kind, found_text, entity, gender) of every item of every text, and the number of texts; _h marks the text of a row."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("_k"), _mark(key, text).alias("_h"), F.col(text).alias("_t"))
    total = rows.count()
    counted = counted_names(rows, "_t")
    contexts = cut(name_contexts(counted))
    parts = cut(name_parts(counted, contexts))
    schema = f"_k {kind}, _h string, start int, stop int, kind string, found_text string, entity string, gender string"
    sent_parts = {r["part"] for r in parts.limit(PARTS_SENT + 1).collect()}
    sent_contexts = frozenset(r["context"] for r in contexts.limit(CONTEXTS_SENT + 1).collect())
    own = []  # what is too much to send: each text gets what it holds
    if len(sent_parts) > PARTS_SENT:
        sent_parts = set()
        own.append(_held_parts(rows, parts))
    if len(sent_contexts) > CONTEXTS_SENT:
        sent_contexts = frozenset()
        own.append(_held_contexts(rows, contexts))
    if own:
        rows = rows.join(reduce(lambda a, b: a.join(b, "_h", "full"), own), "_h", "left")
    shared = df.sparkSession.sparkContext.broadcast((sent_contexts, sent_parts))

    held: list = []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        learned = shared.value[0]
        if not held:
            held.append(automaton_of(shared.value[1]))
        sent = held[0]
        for batch in batches:
            out = []
            mine, near = (batch[c] if c in batch else [None] * len(batch) for c in ("_parts", "_contexts"))
            for k, h, t, known, contexts in zip(batch["_k"], batch["_h"], batch["_t"], mine, near):
                for a, b, what in find_items(t, sent if known is None else set(known), learned if contexts is None else frozenset(contexts)):
                    before = t[max(0, a - 12) : a]
                    gender = "" if what != "person_name" else "f" if _FEMALE.search(before) else "m" if _MALE.search(before) else ""
                    out.append((k, h, a, b, what, t[a:b], entity_of(what, t[a:b]), gender))
            yield pd.DataFrame(out, columns=["_k", "_h", "start", "stop", "kind", "found_text", "entity", "gender"])

    return rows.mapInPandas(run, schema), total


def _mark(key: str, text: str):
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("\0"), F.col(text)))


def entity_surrogates(mentions: DataFrame, secret: str, rounds: int = 20) -> DataFrame:
    """(kind, entity, gender, mentions, surrogate): one replacement an entity, no two alike in a kind and none that is an entity itself.

    An entity is a woman's or a man's if a title says so anywhere. Of entities that draw the same replacement all
    but the smallest draw again, as do those that draw the name of another; counts of clashes come to the driver.
    """
    key = secret.encode()

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["surrogate"] = [replacement(k, e, g, key, int(a)) for k, e, g, a in zip(batch["kind"], batch["entity"], batch["gender"], batch["attempt"])]
            yield batch[["kind", "entity", "gender", "mentions", "attempt", "surrogate"]]

    schema = "kind string, entity string, gender string, mentions long, attempt int, surrogate string"
    entities = mentions.groupBy("kind", "entity").agg(F.max(F.when(F.col("gender") != "", F.col("gender"))).alias("gender"), F.count("*").alias("mentions"))
    drawn = cut(entities.select("kind", "entity", F.coalesce("gender", F.lit("")).alias("gender"), "mentions", F.lit(0).alias("attempt")).mapInPandas(draw, schema))
    for _ in range(rounds):
        first = drawn.groupBy("kind", "surrogate").agg(F.min("entity").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("kind", "surrogate", "_first")
        taken = drawn.select("kind", F.col("entity").alias("surrogate"), F.lit(True).alias("_taken"))
        judged = drawn.join(first, ["kind", "surrogate"], "left").join(taken, ["kind", "surrogate"], "left")
        again = cut(judged.where("_taken or entity != _first").select("kind", "entity", "gender", "mentions", (F.col("attempt") + 1).alias("attempt")))
        if again.isEmpty():
            return drawn
        drawn = cut(drawn.join(again.select("kind", "entity"), ["kind", "entity"], "left_anti").unionByName(again.mapInPandas(draw, schema)))
    raise RuntimeError("surrogates stay alike")


def personal_mentions(df: DataFrame, key: str, text: str, secret: str) -> DataFrame:
    """(_k, _h, start, stop, kind, found_text, entity, surrogate): every item with the replacement of its entity as it is written there."""
    mentions, texts = _mentions(df, key, text)
    found = cut(mentions)
    drawn = entity_surrogates(found, secret)
    placed = spread_join(found.drop("gender"), drawn.select("kind", "entity", "mentions", "surrogate"), ["kind", "entity"], F.col("mentions") >= max(1.0, HOT * texts))

    def dress(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["surrogate"] = [dressed(k, f, e, n) for k, f, e, n in zip(batch["kind"], batch["found_text"], batch["entity"], batch["surrogate"])]
            yield batch

    columns = ["_k", "_h", "start", "stop", "kind", "found_text", "entity", "surrogate"]
    return placed.select(*columns).mapInPandas(dress, placed.select(*columns).schema)


def personal_items(df: DataFrame, key: str, text: str, secret: str) -> DataFrame:
    """(key, kind, found_text, surrogate): each distinct item per row and what replaces it. Null and empty texts give none; a null key is a key."""
    return personal_mentions(df, key, text, secret).select(F.col("_k").alias(key), "kind", "found_text", "surrogate").distinct()


_SINGLE = re.compile(r"(?<![\w@.])[A-Z][a-z]{2,}(?![\w@])")


def replace_items(text: str, items: list[tuple[int, int, str, str, str]]) -> tuple[str, str, int]:
    """The text with typed, numbered placeholders, the text with surrogates, and the number of items, from (start, stop, kind, entity, surrogate).

    After a full name, one of its parts by itself stands for the person, unless a capitalised word stands beside it.
    """
    number: dict[tuple[str, str], int] = {}
    parts: dict[str, tuple[str, str]] = {}
    spans = []
    for start, stop, kind, entity, new in sorted(items):
        if spans and start < spans[-1][1]:
            continue
        number.setdefault((kind, entity), sum(k == kind for k, _ in number) + 1)
        spans.append((start, stop, kind, entity, new))
        if kind == "person_name":
            old, fresh = re.findall(r"[^\W\d_]+", text[start:stop]), re.findall(r"[^\W\d_]+", new)
            for a, b in zip(old, fresh):
                parts.setdefault(a.lower(), (entity, b.lower()))
    if parts:
        free, first = 0, min(s[0] for s in spans if s[2] == "person_name")
        more = []
        for m in _SINGLE.finditer(text, first):
            while free < len(spans) and spans[free][1] <= m.start():
                free += 1
            if m[0].lower() in parts and not (free < len(spans) and spans[free][0] < m.end()) and not re.match(r" [A-Z]", text[m.end() : m.end() + 2]) and not re.search(r"[A-Z]\w* $", text[max(0, m.start() - 20) : m.start()]):
                entity, new = parts[m[0].lower()]
                more.append((*m.span(), "person_name", entity, new.capitalize()))
        spans = sorted([*spans, *more])
    marked, swapped, at = [], [], 0
    for start, stop, kind, entity, new in spans:
        marked += [text[at:start], f"[{kind.upper()}_{number[kind, entity]}]"]
        swapped += [text[at:start], new]
        at = stop
    return "".join([*marked, text[at:]]), "".join([*swapped, text[at:]]), len(spans)


def redact(df: DataFrame, key: str, text: str, secret: str) -> DataFrame:
    """(key, placeholders, surrogates, items) per row with a text: see replace_items. ``secret`` keys the surrogates and is to be kept."""
    kind = df.schema[key].dataType.simpleString()
    found = personal_mentions(df, key, text, secret).groupBy("_h").agg(F.collect_set(F.struct("start", "stop", "kind", "entity", "surrogate")).alias("_items"))  # at most the items of a text
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("_k"), _mark(key, text).alias("_h"), F.col(text).alias("_t")).join(found, "_h", "left").select("_k", "_t", "_items")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, *replace_items(t, [tuple(i[c] for c in ("start", "stop", "kind", "entity", "surrogate")) for i in items] if items is not None else [])) for k, t, items in zip(batch["_k"], batch["_t"], batch["_items"])]
            yield pd.DataFrame(out, columns=["_k", "placeholders", "surrogates", "items"])

    return rows.mapInPandas(run, f"_k {kind}, placeholders string, surrogates string, items int").withColumnRenamed("_k", key)
