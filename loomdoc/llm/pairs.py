"""Problem 1: broken prompt and response pairs.

A pair is checked for an empty, copied, refused, truncated and foreign response, in this order. Languages
are compared by the posteriors of character n-gram naive Bayes; truncation is judged by how likely a text
ends where the response does, from n-gram counts of all responses.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdoc.llm.language import ABBREVIATIONS, NaiveBayes, script_languages, sentences
from loomdoc.operators.ranking import spread_join
from loomdoc.session import cut

#: Stand-ins for nothing said, and bare labels that a response is introduced with.
STAND_INS = {"null", "none", "nan", "nil", "n/a", "na", "undefined", "empty", "no response", "no answer", "tbd", "not available", "no reply", "blank", "nat"}
BARE = {"answer", "ans", "a", "response", "reply", "assistant", "bot", "output", "result", "उत्तर", "जवाब", "jawab", "uttar", "réponse", "उत्तर दें", "উত্তর", "q", "question", "here is the answer", "final answer"}
PRESENTED = r"(?:you asked|your question(?: was| is)?|you said|user|question|query|q|a|answer|ans|assistant|bot|re|prompt|human|asked|aapne poocha|aapka sawal|आपका प्रश्न|आपने पूछा|प्रश्न|उत्तर|तुमचा प्रश्न|আপনার প্রশ্ন|প্রশ্ন|উত্তর|votre question(?: est| était)?|vous avez demandé|réponse)"
_PRESENTED = re.compile(rf"^[\s>*#\"'“‘«\[(_-]*{PRESENTED}\s*[:.\-–—]+\s*", re.I)
#: How a refusal opens, and what one says; what may follow it without being an answer.
_OPENS = re.compile(
    r"^\W*(?:(?:i'?m |i am |we are |so |very )*sorry(?:,| but\b)|unfortunately,|apologies,|my apologies,|i regret that|i'?m afraid|as an? (?:ai|assistant|language model|chatbot)\b|désolé|je suis désolé|malheureusement,|je regrette|"
    r"sorry,|maaf kij?iye,|maaf kare,|kshama kare,|क्षमा करें,|माफ़? ?कीजिए,|माफ़ करें,|खेद है कि|क्षमस्व,|माफ करा,|দুঃখিত,|ক্ষমা করবেন,)", re.I)  # fmt: skip
_DENIES = re.compile(
    r"\b(?:i|we) (?:can ?not|can'?t|could not|am unable|are unable|am not (?:able|allowed|permitted)|have no (?:way|information|answer|knowledge)|must decline|decline to|do(?:n'?t| not) (?:know|have)|will not|won'?t|would rather not)\b"
    r"|beyond my|outside (?:of )?(?:what i|my)|not something i can|what i can (?:discuss|advise)|cannot be given here|for me to (?:reply|answer)|ask someone else|could be found in|answer can be given|documents i have|not (?:available )?in the documents|comment on|let us talk about something|not in a position to"
    r"|je ne (?:peux|suis|dispose|sais)\b|je n'ai pas|hors de mon|ne relève pas|aucune information"
    r"|jawab (?:nahi|mere paas nahi)|mere paas nahi|(?:nahi|na) (?:kar|keh|bata|de) (?:paunga|sakta|sakti|paungi)\b.*|daayre se bahar|documents? me nahi|main .*nahi (?:de|keh|kar|bata)|mujhe nahi pata"
    r"|असमर्थ हूँ|(?:मैं|मेरे|मुझे)(?: \S+){0,8} (?:नहीं|असमर्थ)|मेरे लिए (?:\S+ )*(?:उचित|संभव) नहीं|मेरे पास|कार्यक्षेत्र से बाहर|किसी और से पूछें|दस्तावेज़(?:ों)? में (?:\S+ )*नहीं|सहायता नहीं कर|जानकारी (?:मेरे पास )?नहीं (?:है|मिली)"
    r"|मी (?:\S+ )*(?:शकत नाही|देऊ शकत)|देता येणार नाही|माहिती उपलब्ध नाही|माझ्याकडे|पারছি না|পারছি না|আমার (?:জানা|কাছে)|কোনো তথ্য নেই|বলতে পার(?:ছি|ব) না|আমি .*না।?$", re.I)  # fmt: skip
#: Each denial holds one of these, which are quicker to look for.
_DENIAL_STEMS = (
    "not", "n't", "dont", "cant", "wont", "unable", "have no", "decline", "beyond my", "outside", "what i can", "for me to", "can be given", "documents i have", "comment on", "let us talk", "someone else", "be found in",
    "je ne", "n'ai pas", "hors de mon", "relève", "aucune info", "nahi", "na ", "daayre", "असमर्थ", "नहीं", "मेरे पास", "कार्यक्षेत्र", "किसी और", "शकत", "नाही", "माझ्याकडे", "পারছি", "আমার", "নেই", "পার", "আমি",
)


def denies_in(sentence: str) -> re.Match | None:
    low = sentence.lower()
    return _DENIES.search(sentence) if any(x in low for x in _DENIAL_STEMS) else None


_FIRST_PERSON_ROMAN = re.compile(r"\b(?:main|mere|mera|mujhe|hum)\b|documents? me nahi", re.I)
_CLOSES = re.compile(
    r"^\W*(?:(?:please|kindly) (?:contact|ask|try|consult|check|reach|write|refer|raise|visit)|try asking|you may (?:contact|ask)|contact the|ask (?:me )?something|is there anything else|feel free|"
    r"helpdesk se|kisi aur|koi (?:aur|doosra)|kripya|veuillez|posez|essayez|कृपया (?:\S+ )*(?:संपर्क|पूछें|साधा)|कोई (?:अन्य|और) प्रश्न|सहायता केंद्र|दूसरा प्रश्न|दुसरा|অন্য|অনুগ্রহ|thank|dhanyav|धन्यवाद|ধন্যবাদ|merci)", re.I)  # fmt: skip
#: Requests for the language of the answer.
_ASKS = (
    ("en", re.compile(r"\b(?:in|into) english\b|(?:english|angrezi|angreji) (?:me|mein)\b|(?:अंग्रेज़?ी|इंग्लिश) (?:में|मे|भाषा)|इंग्रजीत|इंग्रजी (?:मध्ये|भाषेत)|ইংরেজিতে|ইংরেজি ভাষায়|en anglais", re.I)),
    ("hi", re.compile(r"\bin hindi\b|\bhindi (?:me|mein)\b|हिन्?ं?दी (?:में|मध्ये)|हिंदीत|হিন্দিতে|en hindi", re.I)),
    ("hi-Latn", re.compile(r"\bin (?:hinglish|roman hindi)\b|hinglish (?:me|mein)\b|हिंग्लिश", re.I)),
    ("mr", re.compile(r"\bin marathi\b|marathi (?:me|mein|madhye)\b|मराठी(?:त| में)|মারাঠিতে|en marathi", re.I)),
    ("bn", re.compile(r"\bin (?:bengali|bangla)\b|(?:bangla|bengali) (?:me|mein)\b|बंगाली में|बांग्ला में|বাংলায়|en bengali", re.I)),
    ("fr", re.compile(r"\bin french\b|french (?:me|mein)\b|फ्रेंच (?:में|मध्ये)|ফরাসিতে|en français", re.I)),
)
_NOTE_WORD = re.compile(r"for details|please see|see|source|ref|स्रोत|উৎস|srot|page|pg|p\.|पृष्ठ|पान|পৃষ্ঠা", re.I)
_NOTE = re.compile(
    r"[\s\-–—]*[(\[]?\s*(?:(?:for details |please )?see (?:also )?(?:rule|annexure|annex|clause|section|para|page|chapter|appendix|form)\s*[\dA-Z][\d.]*(?:\s*\([ivx\d]+\))?|(?:source|ref(?:erence)?|स्रोत|उৎস|srot)[.: ]{1,2}[^\n.।]*\d|(?:page|pg\.?|p\.|पृष्ठ|पान|পৃষ্ঠা)\s*(?:no\.?\s*)?[\d०-९০-৯]+(?:\s*(?:of|/)\s*\d+)?)\s*[)\]]?\s*$", re.I)
_ENDS = ".?!।॥|"
_WORD = re.compile(r"\d+(?:[.,/:-]\d+)*|[^\W_]+(?:[^\W_]|[ऀ-ॣঀ-ৣ‍‌'’-])*|\.\.+|[.…?!।॥\n]")
#: Words that no sentence ends in: conjunctions, prepositions, determiners and their like.
DANGLING = set(
    "a an the this that these which of to in for with by and or but because if when where under from as at on into than may can shall will must not be is are was were so such while until unless although "
    "de la le les des du un une et ou en à au aux que qui si car dans avec pour par sur mais dont "
    "aur lekin kyunki agar ki ke ka ko me par se jo jis jiske jisme tatha ya is us uske iske baad dwara antargat taki "
    "और लेकिन क्योंकि यदि अगर कि के की का को में पर से जो जिस जिसके जिसमें तथा या इस उस इसके उसके बाद द्वारा अंतर्गत ताकि परंतु किंतु एवं "
    "आणि पण कारण जर त्यानंतर किंवा ज्या त्या ची चे चा च्या मध्ये साठी परंतु मात्र "
    "এবং কিন্তু কারণ যদি তারপর বা এই সেই যে এর জন্য থেকে তবে অথবা যার".split())  # fmt: skip
#: Lengths of the word contexts that ends are counted after; the start of a sentence or line counts as a word.
ORDERS = (1, 2, 3, 4, 5, 6)
#: Share of all responses that an unmarked ending must close to be a usual one. A cut falls on any character, so each particular one is far rarer.
USUAL = 0.001
#: Occurrences of a context, or of an unmarked ending, below which it says nothing.
LEAST = 5
#: Characters that are counted or judged at once in a task.
_CHUNK = 2_000_000


def letters(text: str) -> list[str]:
    return re.findall(r"[^\W_](?:[^\W_]|[ऀ-ॣঀ-ৣ‍‌])*", re.sub(r"(?<=\d)[,.](?=\d)", "", text.lower()))


_WRAPPER = re.compile(r"<[^<>]*>|&(?:[a-z]+|#\d+);|```\w*", re.I)


def is_empty(response: str | None) -> bool:
    if response is None:
        return True
    x = _WRAPPER.sub(" ", response) if "<" in response or "&" in response or "`" in response else response
    for _ in re.finditer(r"[^\W_]", x):  # the first letter or digit, if there is one
        break
    else:
        return True
    bare = x.strip()
    if len(bare) > _LONGEST and "  " not in bare and "\n" not in bare and not _PADDED.search(bare):
        return False  # words in a row are more than any stand-in or label has
    words = " ".join(letters(x))
    return not words or words in STAND_INS or words in BARE or words.replace(" ", "/") in STAND_INS


_LONGEST = 4 * max(map(len, STAND_INS | BARE))
_PADDED = re.compile(r"[\W_]{3}")


def is_copy(query: str, response: str) -> bool:
    """Whether the response only gives the question back: in other dress, behind an introduction, more than once, or with a word lost for every eight."""
    asked = letters(query)
    if not asked:
        return False
    may_lose, low = max(1, len(asked) // 8), response.lower()
    if "," in query or "." in query or "," in response:
        low = re.sub(r"(?<=\d)[,.](?=\d)", "", low)
    missing = 0
    for w in asked:
        if w not in low:
            missing += 1
            if missing > may_lose:
                return False
    parts: list[str] = []
    lines = re.split(r"\n+", response)
    for line in lines:
        previous = None
        while previous != line:
            previous, line = line, _PRESENTED.sub("", line)
        parts += letters(line)
    n = len(asked)
    times = 0
    while parts[:n] == asked:
        parts, times = parts[n:], times + 1
    if times:
        return not parts or " ".join(parts) in BARE or _lost(asked, parts)
    if _lost(asked, parts):
        return True
    for m in reversed(list(_INTRODUCED.finditer(response))):  # a sentence that introduces the question, and nothing after it
        rest = letters(response[m.end() :])
        if len(rest) > n:
            return False
        if (rest == asked or _lost(asked, rest)) and _ASKING.search(response[: m.end()]):
            return True
    return False


_INTRODUCED = re.compile(r"[:–—\n]")
#: Words that an introduction of the question has.
_ASKING = re.compile(r"\b(?:question|query|asked|ask|prompt|poocha|sawal|demandé|demande)\b|प्रश्न|पूछा|सवाल|विचार|প্রশ্ন", re.I)


def _lost(asked: list[str], said: list[str]) -> bool:
    """Whether ``said`` is ``asked`` with at most a word lost for every eight, and no other word."""
    if not said or not 0 < len(asked) - len(said) <= max(1, len(asked) // 8):
        return False
    it = iter(asked)
    return all(any(w == a for a in it) for w in said)


def is_refusal(response: str) -> bool:
    """Whether every sentence declines, opens with an apology, or only sends elsewhere, and one declines."""
    first = re.split(r"(?<=[.?!।])\s|\n", response.strip(), maxsplit=1)[0]
    if not (_OPENS.search(first) or denies_in(first) or _CLOSES.search(first) or _NOTE.fullmatch(first)):
        return False
    declined = False
    for s in sentences(re.sub(r"\s*\n\s*", " ", response)):
        opens, denies = _OPENS.search(s), denies_in(s)
        if denies and re.search(r"nahi", denies[0], re.I) and not opens and not _FIRST_PERSON_ROMAN.search(s) and "jawab" not in s.lower():
            denies = None
        if opens or denies:
            declined = True
        elif not _CLOSES.search(s) and not _NOTE.fullmatch(s):
            return False
    return declined


_MARKS = frozenset(".…?!।॥\n")
_BOUND, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def word_contexts(texts: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Of the words and marks of all texts, a line break after each: what they are (0 a word, 1 a mark, 2 a break or dots of omission, 3 the point of an abbreviation),
    and for each length in ORDERS the places that have a context of that length, and its hash."""
    words = np.array(_WORD.findall("\n".join(texts).lower() + "\n"), dtype=object)
    code, known = pd.factorize(words)
    kind_of = np.array([0 if w[0] not in _MARKS else 2 if w == "\n" or w[0] == "…" or w[:2] == ".." else 1 for w in known], dtype=np.int8)
    hash_of = pd.util.hash_array(np.array(["0" if w[0].isdigit() else w for w in known], dtype=object), categorize=False)
    hash_of[kind_of > 0] = _BOUND
    kind, h = kind_of[code], hash_of[code]
    short = np.array([w in ABBREVIATIONS for w in known])[code]
    kind[1:][(kind[1:] == 1) & short[:-1]] = 3  # the point of an abbreviation ends nothing
    at = np.arange(len(h))
    since = at - np.maximum.accumulate(np.where(kind > 0, at, -1))  # words since the last mark; the first text follows one
    rolled, out = np.zeros(len(h), dtype=np.uint64), []
    with np.errstate(over="ignore"):
        for n in ORDERS:
            shifted = np.full(len(h), _BOUND, dtype=np.uint64)
            shifted[n - 1 :] = h[: max(0, len(h) - n + 1)]
            rolled = (rolled ^ shifted) * _STEP + np.uint64(n)
            place = np.flatnonzero((kind == 0) & (since >= max(1, n - 1)))
            out.append((place, (rolled[place] ^ (rolled[place] >> np.uint64(31))).view(np.int64)))
    return kind, out


def count_ends(texts: list[str]) -> pd.DataFrame:
    """Per context its places, those before a mark, and those at the end of a text or line without one."""
    kind, contexts = word_contexts(texts)
    parts = [(found, kind[place + 1]) for place, found in contexts]
    return count_table(np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts]))


def count_table(context: np.ndarray, after: np.ndarray) -> pd.DataFrame:
    order = np.argsort(context, kind="stable")
    context, after = context[order], after[order]
    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, dtype=int)
    sums = [np.add.reduceat(x.astype(np.int64), first) if len(first) else np.zeros(0, dtype=np.int64) for x in (np.ones(len(after)), after == 1, after == 2)]
    return pd.DataFrame({"context": context[first], "places": sums[0], "marked": sums[1], "bare": sums[2]})


_RUN_END = re.compile(r"[?!।॥…\n]|\.(?!\d)")


def last_run(text: str) -> str:
    """The words after the last mark or line break of a text; nothing where a mark ends it."""
    text = text.rstrip()
    return "" if text[-1:] in _MARKS else _RUN_END.split(text)[-1]


def last_contexts(texts: list[str]) -> list[list[tuple[int, int]]]:
    """(length, context) of the end of each text that no mark ends."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    kind, contexts = word_contexts([last_run(t) for t in texts])
    line = kind == 2  # a last run has no dots
    text_of = np.cumsum(line) - line
    ends = np.zeros(len(kind), dtype=bool)
    ends[:-1] = line[1:]
    for n, (place, found) in zip(ORDERS, contexts):
        here = ends[place]
        for k, c in zip(text_of[place[here]].tolist(), found[here].tolist()):
            out[k].append((n, c))
    return out


_CLOSERS = " \t\r\n*_\"'”’»)]"


def without_note(text: str) -> str:
    """The text without the page notes, closing marks and dots of omission at its end."""
    bare = text.rstrip()
    while True:
        begin = bare.rfind("\n") + 1
        for word in _NOTE_WORD.finditer(bare, begin):
            at = word.start()
            while at > begin and bare[at - 1] in " \t-–—([":
                at -= 1
            if _NOTE.match(bare, at):
                break
        else:
            break
        if not bare[:at].strip():
            break
        bare = bare[:at].rstrip()
    bare = bare.rstrip(_CLOSERS)
    return bare.rstrip(".… ") if bare.endswith(("..", "…")) else bare


class EndModel:
    """How likely a text ends after its last words: the share of ends among all places of the longest known context.

    Ends without a mark count where they are a usual close: after USUAL of all responses, and not in a word that
    no sentence ends in.
    """

    def __init__(self, counts: dict[int, tuple[int, int, int]], responses: int):
        self.counts, self.usual = counts, max(LEAST, USUAL * responses)

    def likely(self, text: str) -> float:
        words = _WORD.findall(last_run(text).lower())
        hangs = not words or words[-1] in DANGLING
        for n in reversed(ORDERS):
            places, marked, bare = self.counts.get(n, (0, 0, 0))
            if places >= LEAST:
                return (marked + (bare - 1 if bare >= self.usual and not hangs else 0)) / (places - 1)
        return 0.0


def is_truncated(response: str, model: EndModel) -> bool:
    """Whether the text breaks off: inside a bracket, a list item or a sentence."""
    text = response.rstrip()
    last = text.rsplit("\n", 1)[-1].strip()
    if re.fullmatch(r"(?:[-*•]|\(?\d{1,2}[.)]|\(?[a-z][.)])?[\s*_]*", last):
        return True
    bare = text if text[-1] in _ENDS and not text.endswith("..") else without_note(text)
    if not bare:
        return False
    if bare[-1] in _ENDS:
        if bare[-1] != ".":
            return False
        word = bare[:-1].rsplit(None, 1)[-1].lower() if bare[:-1].strip() else ""
        return (word in {"rs", "no", "pg", "m/s", "dr", "viz"} or bare.count("(") > text.count(")") + 1)
    if bare[-1] in ",:;-–—(/&" or text.count("(") > text.count(")"):
        return True
    return model.likely(bare) < 0.2


def foreign(pairs: list[tuple[str, str]], model: NaiveBayes, sure: float = 0.9, may_be: float = 0.5) -> list[bool]:
    """Per (query, response), whether the response is in a language that the query is neither written in nor asks for.

    Languages are those of sentences of three words or more, by their posteriors; the response's is the one with
    most words among those that are sure. Lines that repeat the query are no part of the response.
    """
    texts: list[str] = []
    owner: list[tuple[int, int, int]] = []  # pair, 0 query 1 response 2 whole query, words

    def add(i: int, side: int, text: str) -> None:
        for s in sentences(text):
            if (size := s.count(" ") + 1) >= 3:
                texts.append(s)
                owner.append((i, side, size))

    for i, (query, response) in enumerate(pairs):
        again = query.strip()[:12].lower()
        body = response
        if again and again in response.lower():
            asked = letters(query)
            body = "\n".join(x for x in response.split("\n") if letters(x) != asked)
        add(i, 0, query)
        add(i, 1, body)
        texts.append(query)
        owner.append((i, 2, 0))
    meant: list[set] = [set() for _ in pairs]
    whole: list[str | None] = [None] * len(pairs)
    said: list[Counter | None] = [None] * len(pairs)
    for (i, side, size), (lang, p) in zip(owner, model.posteriors(texts)):
        if lang is None:
            continue
        if side == 0 and p >= may_be:
            meant[i].add(lang)
        elif side == 1 and p >= sure:
            if said[i] is None:
                said[i] = Counter()
            said[i][lang] += size
        elif side == 2:
            whole[i] = lang
    out = []
    for (query, _), known, best, counts in zip(pairs, meant, whole, said):
        if not counts:
            out.append(False)
            continue
        main = counts.most_common(1)[0][0]
        known = known or ({best} if best else set())
        if main in known:
            out.append(False)
            continue
        asked = {lang for lang, pattern in _ASKS if pattern.search(query)}
        out.append(main not in (asked | known) if known or asked else main not in script_languages(query))
    return out


def defects(rows: list[tuple[str, str | None, EndModel]], model: NaiveBayes) -> list[str | None]:
    """The first defect that fits each (query, response, how ends are likely)."""
    out: list[str | None] = []
    for query, response, ends in rows:
        if is_empty(response):
            out.append("empty")
        elif is_copy(query, response):
            out.append("copy")
        elif is_refusal(response):
            out.append("refusal")
        else:
            out.append("truncated" if is_truncated(response, ends) else None)
    left = [i for i, kind in enumerate(out) if kind is None]
    for i, strange in zip(left, foreign([rows[i][:2] for i in left], model)):
        if strange:
            out[i] = "other_language"
    return out


def _chunks(texts: list[str]) -> Iterator[slice]:
    """Slices of a batch of about _CHUNK characters, whatever the length of its texts."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= _CHUNK:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def end_counts(df: DataFrame, response: str, least: int = LEAST) -> DataFrame:
    """(context, places, marked, bare) over all responses; contexts in fewer than ``least`` places say nothing and are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["t"].tolist()
            for part in _chunks(texts):
                yield count_ends(texts[part])

    part = df.where(F.col(response).isNotNull()).select(F.col(response).alias("t")).mapInPandas(run, "context long, places long, marked long, bare long")
    return part.groupBy("context").agg(*[F.sum(x).alias(x) for x in ("places", "marked", "bare")]).where(F.col("places") >= least)


def broken_pairs(df: DataFrame, sample: dict[str, list[str]]) -> DataFrame:
    """(id, defect, feedback) of rows with a non-blank query and a defective response.

    ``sample`` is the bounded labelled sample of language.labelled_sample. Only responses without a final
    mark need end counts: their last contexts are joined with the counts of all responses, so that no model
    of the corpus is sent about. Contexts that close USUAL of all responses, at most len(ORDERS) / USUAL of
    them, are broadcast, so that no hot one is gathered. Rows with a null id or a null or blank query give none; a repeated id counts once; feedback may be
    null and plays no part.
    """
    shared = df.sparkSession.sparkContext.broadcast(NaiveBayes(sample, (2, 3)).table)  # of fixed size
    rows = df.where(r"id is not null and query rlike '[\\p{L}\\p{N}]'").select("id", "query", "response", "feedback")
    open_end = ~F.col("response").rlike(r"(?<!\.)[.?!।॥][\s\"'”’)*_\]]*$")

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = last_contexts([without_note(t) for t in batch["response"]])
            yield pd.DataFrame([(key, n, c) for key, of in zip(batch["id"], found) for n, c in of], columns=["id", "n", "context"])

    total = df.count()  # read from the footers of the files
    wanted = cut(rows.where(open_end).select("id", "response").mapInPandas(contexts, "id string, n int, context long"))
    known = spread_join(wanted, cut(end_counts(df, "response")), ["context"], F.col("bare") >= max(LEAST, USUAL * total))
    known = known.groupBy("id").agg(F.collect_set(F.struct("n", F.array("places", "marked", "bare").alias("c"))).alias("ends"))  # at most one a length
    held: list[NaiveBayes] = []

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = held[0] if held else NaiveBayes({}, (2, 3), shared.value)
        held.append(model)
        for batch in batches:
            asked = [(q, r, EndModel({e["n"]: tuple(e["c"]) for e in ends} if ends is not None else {}, total)) for q, r, ends in zip(batch["query"], batch["response"], batch["ends"])]
            found = [kind for part in _chunks([r or "" for _, r, _ in asked]) for kind in defects(asked[part], model)]
            out = batch[["id", "feedback"]].assign(defect=found)
            yield out[out["defect"].notna()][["id", "defect", "feedback"]]

    judged = rows.join(known, "id", "left").mapInPandas(judge, "id string, defect string, feedback string")
    order = F.array_position(F.array(*[F.lit(x) for x in ("empty", "copy", "refusal", "truncated", "other_language")]), F.col("defect"))
    return judged.groupBy("id").agg(F.min_by("defect", order).alias("defect"), F.max("feedback").alias("feedback"))
