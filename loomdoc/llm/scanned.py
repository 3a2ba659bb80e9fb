"""Problem 2: noise in text from scanned pages.

Noisy channel: each word of a body line may be a misreading of a corpus word under character confusions,
whose probabilities are estimated from the corpus; Viterbi decoding over the candidates of a line weighs
them with bigram likelihood. Candidates are found once for each distinct word, in a table; every page gets
the words and pairs that it needs by joins. Lines at the edge of a page that recur over pages are furniture,
and words broken over two lines are joined as the corpus writes them.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdoc.operators.ranking import spread_join
from loomdoc.session import cut

#: What is read, and what may have been written.
CONFUSIONS = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "b"), ("9", "g"), ("8", "b"), ("2", "z"), ("rn", "m"), ("m", "rn"), ("ri", "n"), ("n", "ri"), ("ii", "u"), ("u", "ii"), ("li", "u"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("w", "vv"),
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("l", "i"), ("i", "l"), ("b", "h"), ("h", "b"), ("y", "v"), ("v", "y"), ("u", "n"), ("n", "u"), ("o", "a"), ("a", "o"), ("c", "o"), ("o", "c"), ("q", "g"), ("g", "q"), ("|", "l"), ("!", "l"), ("h", "li"), ("tl", "h"), ("nn", "m"), ("in", "m"),
    ("ि", "ी"), ("ी", "ि"), ("ो", "ी"), ("ी", "ो"), ("ै", "े"), ("े", "ै"), ("ु", "ू"), ("ू", "ु"), ("ौ", "ो"), ("ो", "ौ"), ("ं", "ँ"), ("ँ", "ं"), ("भ", "म"), ("म", "भ"), ("ब", "व"), ("व", "ब"), ("घ", "ध"), ("ध", "घ"), ("य", "थ"), ("थ", "य"), ("प", "ष"), ("ष", "प"), ("ड", "ड़"), ("ढ", "ढ़"), ("ड", "इ"), ("इ", "ड"), ("न", "त"), ("त", "न"), ("र", "स"), ("ख", "रव"), ("रव", "ख"), ("ण", "रा"), ("श", "रा"), ("द", "ट"), ("ट", "द"), ("क", "फ"), ("फ", "क"), ("ज", "च"), ("च", "ज"), ("ल", "त"), ("ग", "म"), ("ह", "ड"),
)
_DIGITS = str.maketrans({"o": "0", "O": "0", "l": "1", "I": "1", "i": "1", "|": "1", "s": "5", "S": "5", "b": "6", "B": "8", "g": "9", "q": "9", "z": "2", "Z": "2"})
_EDGES = " \t\r.,;:!?।॥()[]{}<>\"'“”‘’«»*_=–—-‐¬­/…"
_BREAK = re.compile("[-‐¬­]$")
_PAGE_WORDS = re.compile(r"page|pg|p|no|of|पृष्ठ|सं|संख्या|पेज|पान", re.I)
_INDIC_DIGITS = str.maketrans("०१२३४५६७८९", "0123456789")
_STOPS = ".।?!:;"
#: A word is one in its own right if it is more frequent than this, measured by a word that it may be a misreading of.
OWN_WORD = 0.12
#: Words that make up this share of the corpus, at most 1 / FREQUENT, are sent to the tasks; all others are joined to the pages that have them.
FREQUENT = 1e-5
#: Occurrences below which a word of digits and letters is a misread number in any corpus.
CODE = 5
#: Share of all pages, or of all pairs of words, above which a header or pair is hot: at most (edge lines of a page) / HOT are.
HOT = 0.001
#: Share of the files with an edge line at which it recurs in them, from which it is a header in the others, too.
RECURS = 0.5
_BITS = 1 << 24


def core(token: str) -> str:
    return token.strip(_EDGES).lower()


def as_number(token: str) -> str | None:
    """The number that a token with letters among its digits stands for."""
    t = token.strip(_EDGES)
    if not any(c.isascii() and c.isdigit() for c in t) or not any(c.isalpha() or c == "|" for c in t):
        return None
    n = t.translate(_DIGITS)
    return n.lower() if re.fullmatch(r"\d+(?:[.,/:-]\d+)*", n) and sum(c.isdigit() for c in t) >= (1 if len(t) <= 3 else len(t) / 4) else None


_DIGIT = re.compile("[0-9]")


@lru_cache(maxsize=200_000)
def read_token(token: str) -> tuple[str, str, str | None]:
    """Core, plain word and number of a token; most tokens come again and again."""
    c = core(token)
    if c.isalpha() or not _DIGIT.search(c):
        return c, plain_word(c), None
    return c, plain_word(c), as_number(token)


def page_lines(text: str) -> list[str]:
    return [x.rstrip("\r") for x in text.split("\n")]


def is_page_number(line: str, page: int | None) -> bool:
    """Whether a line says only the number of its page, with page words and ornaments."""
    rest = _PAGE_WORDS.sub(" ", line.translate(_INDIC_DIGITS))
    numbers = [n.translate(_DIGITS) for n in re.findall(r"[0-9oOlIi|sSbBgqzZ]+", rest)]
    if not numbers or not re.fullmatch(r"[\s\-–—\[\]()|/.:*~#]*(?:[0-9oOlIi|sSbBgqzZ]+[\s\-–—\[\]()|/.:*~#]*){1,2}", rest):
        return False
    return page is not None and numbers[0].isdigit() and int(numbers[0]) == page


_ALIKE = str.maketrans(dict(zip("o c s i b h f t y".split(), "e e l l h h t t v".split())) | dict(zip("ी ो म व े ध".split(), "ि ि भ ब ै घ".split())))


def header_key(line: str, page: int | None) -> str:
    """A line as its copies on other pages are likely to have it: without digits, case, spacing and what is easily misread."""
    x = re.sub(r"\b[\doil|sbgqz]*\d[\doil|sbgqz]*\b", "", line.strip().lower())  # numbers, also with misread digits
    x = re.sub(r"(?<=[a-z])[01569](?=[a-z ]|$)|(?<![\w])[01569](?=[a-z])", lambda m: "olsbg"["01569".index(m[0])], re.sub(r"\s+", " ", x))
    x = re.sub(r"[\d०-९]+", "", x)
    x = x.replace("rn", "m").replace("vv", "w").replace("cl", "d").replace("ii", "u").replace("ri", "n")
    x = x.translate(_ALIKE)
    return re.sub(r"[^\w ऀ-ॿ-]+|\b[oil|s]\b", "", x).strip(" -")


class Shape:
    """The lines of a page and what the form of each allows."""

    def __init__(self, text: str):
        self.lines = page_lines(text)
        self.full = [i for i, x in enumerate(self.lines) if x.strip()]
        self.width = max((len(self.lines[i].strip()) for i in self.full), default=0)

    def may_be_header(self, i: int, share: float = 0.86) -> bool:
        """Whether the form of a line allows a running title: it leaves some of the width, ends no sentence and heads no column."""
        line = self.lines[i].strip()
        if line[-1] in _STOPS or len(line) >= max(share * self.width, 12) or _BREAK.search(line) or len(re.findall(r"[^\W\d_]", line)) <= 3:
            return False
        beside = [self.lines[j].strip() for j in (i - 1, i + 1) if 0 <= j < len(self.lines)]
        return not (len(line) < 12 and any(re.fullmatch(r"[\d०-९]+(?:[.,]\d+)*", b) for b in beside))

    def edge(self, foot: bool) -> Iterator[int]:
        """Lines from an edge inwards that may be furniture: two of any width, and after them narrow ones for as long as they go on."""
        for n, i in enumerate(reversed(self.full) if foot else self.full):
            if n > 1 and not self.may_be_header(i) and re.search(r"[^\W\d_]{4}", self.lines[i]):
                return
            yield i


def _edge_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, path, page, text in zip(batch["page_id"], batch["file_path"], batch["page_num"], batch["page_content"]):
            shape, page = Shape(text), None if pd.isna(page) else int(page)
            keys: dict[str, bool] = {}
            for i in {*shape.edge(False), *shape.edge(True)}:
                if shape.may_be_header(i, 1.01) and (k := header_key(shape.lines[i], page)):
                    keys[k] = keys.get(k, False) or shape.may_be_header(i)
            rows += [(key, path, k, narrow) for k, narrow in keys.items()]
        yield pd.DataFrame(rows, columns=["page_id", "file_path", "key", "narrow"])


def broken_end(tokens: list[str]) -> bool:
    return bool(tokens) and len(tokens[-1]) > 1 and _BREAK.search(tokens[-1]) is not None


def joined(left: str, right: str) -> tuple[str, str]:
    """What two parts of a broken word may be: one piece, or a compound."""
    a, b = core(_BREAK.sub("", left)), core(right)
    return a + b, f"{a}-{b}"


def plain_word(c: str) -> str:
    return "0" if c and c[0].isdigit() and c[-1].isdigit() else c


def words_of(text: str) -> Iterator[list[str]]:
    """Words of each line, without those that a line break cuts."""
    cut_before = False
    for line in page_lines(text):
        tokens = line.split()
        cut_after = broken_end(tokens)
        whole = tokens[1 if cut_before else 0 : -1 if cut_after else None]
        cut_before = cut_after
        yield [w for t in whole if (w := read_token(t)[1])]


def joins_of(text: str) -> Iterator[str]:
    """What the broken words of a text may be."""
    lines = [line.split() for line in page_lines(text)]
    for tokens, after in zip(lines, lines[1:]):
        if broken_end(tokens) and after:
            yield from joined(tokens[-1], after[0])


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        seen: Counter = Counter()
        for text in batch["page_content"]:
            for words in words_of(text):
                seen.update(words)
                seen.update([f"{a} {b}" for a, b in zip(words, words[1:])])
            for word in joins_of(text):
                seen[word] += 0  # asked for, but not seen
        yield pd.DataFrame(list(seen.items()), columns=["gram", "n"])


def variants(word: str) -> Iterator[tuple[str, int]]:
    """(word that one confusion may have made this one of, number of the confusion)."""
    for k, (read, written) in enumerate(CONFUSIONS):
        at = word.find(read)
        while at >= 0:
            yield word[:at] + written + word[at + len(read) :], k
            at = word.find(read, at + 1)


def _explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([(w, n, v, k) for w, n in zip(batch["gram"], batch["n"]) for v, k in variants(w)], columns=["read", "n_read", "gram", "confusion"])


def _chances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        total: Counter = Counter()
        for w, n in zip(batch["gram"], batch["n"]):
            for k, (_, written) in enumerate(CONFUSIONS):
                if written in w:
                    total[k] += n
        yield pd.DataFrame(list(total.items()), columns=["confusion", "chances"])


class Word(NamedTuple):
    """A word of the corpus: how often it stands there, how often by its own right, and what it may be a misreading of."""

    seen: int = 0
    own: float = 0.0
    options: tuple = ()  # (word, log of the channel's probability, seen, own)


_UNSEEN = Word()


class Channel:
    """Corrects lines: candidate words by confusions, decoded by Viterbi with bigram likelihood."""

    def __init__(self, words: dict[str, Word], total: int, rare: dict[str, Word] | None = None, pairs: dict[str, int] | None = None):
        self.words, self.total, self.rare, self.pairs = words, total, rare or {}, pairs or {}

    def word(self, word: str) -> Word:
        return self.words.get(word) or self.rare.get(word, _UNSEEN)

    def is_code(self, word: str) -> bool:
        """Whether letters among digits are meant: the word is a frequent one, as no single misread number is."""
        return (of := self.words.get(word)) is not None and of.own >= max(CODE, FREQUENT * self.total)

    def windows(self, line: list[str]) -> Iterator[tuple[int, list[list[tuple[str, float, int, float]]]]]:
        """(first place, options of each word) of every run of words that may be misreadings, with the words beside it."""
        found = [self.word(w) for w in line]
        if not any(w.options for w in found):
            return
        i = 0
        while i < len(line):
            if not found[i].options:
                i += 1
                continue
            start = i
            while i < len(line) and found[i].options:
                i += 1
            low, high = max(0, start - 1), min(len(line), i + 1)
            yield low, [[(line[j], -0.01, found[j].seen, found[j].own), *found[j].options] for j in range(low, high)]

    def asked_pairs(self, line: list[str]) -> Iterator[str]:
        for _, options in self.windows(line):
            for left, right in zip(options, options[1:]):
                yield from (f"{b} {c}" for c, _, _, own in right if own for b, *_ in left)

    def likelihood(self, before: str, seen_before: int, word: str, own: float) -> float:
        pair = self.pairs.get(f"{before} {word}", 0) if own else 0
        return math.log(0.7 * pair / (seen_before + 1) + 0.3 * (own + 1e-3) / self.total)

    def decode(self, line: list[str]) -> list[str]:
        out = list(line)
        for low, options in self.windows(line):
            path = {("", 0): (0.0, None)} if low == 0 else None
            history = []
            for choices in options:
                now = {}
                for word, channel, seen, own in choices:
                    if path is None:  # the word before a run has one option
                        now[word, seen] = (0.0, None)
                        continue
                    score, prev = max(((s + self.likelihood(*b, word, own), b) for b, (s, _) in path.items()), key=lambda x: x[0])
                    now[word, seen] = (score + channel, prev)
                history.append(now)
                path = now
            at = max(path, key=lambda c: path[c][0])
            for j in range(len(history) - 1, -1, -1):
                out[low + j] = at[0]
                at = history[j][at][1]
        return out

    def join(self, left: str, right: str) -> str:
        """A word broken in two: what the corpus writes, in one piece or as a compound, or its likeliest right form."""
        plain, compound = joined(left, right)
        words = [(w, self.word(w)) for w in (plain, compound)]
        best = max(words, key=lambda x: x[1].own)
        if best[1].own:
            return best[0]
        for _, of in words:
            if of.options:
                return max(of.options, key=lambda x: x[1] + math.log(x[3]))[0]
        return plain


class Line(NamedTuple):
    number: int
    tokens: list[str]
    cores: tuple[str, ...]
    plain: tuple[str, ...]
    numbers: dict[int, str]
    carried: bool  # its first token belongs to the word that the line before breaks off
    broken: str | None  # the token that this line's last one goes on in
    decoded: list[int]


def read_page(text: str, page: int | None, headers: set[str], channel: Channel) -> tuple[dict[int, str], list[Line | None]]:
    """Furniture lines by kind, and the body lines as they are decoded; None for a blank one."""
    shape = Shape(text)
    furniture: dict[int, str] = {}
    for foot in (False, True):
        for i in shape.edge(foot):
            if i in furniture:
                continue
            if is_page_number(shape.lines[i], page):
                furniture[i] = "page_number"
            elif headers and shape.may_be_header(i, 1.01) and header_key(shape.lines[i], page) in headers:
                furniture[i] = "header"
            else:
                break
    body = [(i, line.split()) for i, line in enumerate(shape.lines) if i not in furniture]
    out: list[Line | None] = []
    carried = False
    for n, (i, tokens) in enumerate(body):
        if not tokens:
            out.append(None)
            carried = False
            continue
        after = body[n + 1][1] if n + 1 < len(body) else []
        cores, plain, written = zip(*map(read_token, tokens))
        numbers = {j: x for j, x in enumerate(written) if x and not channel.is_code(cores[j])}
        broken = broken_end(tokens) and bool(after) and after[0][0].isalpha() and (after[0][0].islower() or not after[0][0].isascii() or tokens[-1].isupper())
        skip = set(numbers) | ({len(tokens) - 1} if broken else set()) | ({0} if carried else set())
        out.append(Line(i, tokens, cores, plain, numbers, carried, after[0] if broken else None, [j for j, c in enumerate(cores) if c and j not in skip and not c.isdigit()]))
        carried = broken
    return furniture, out


def repair_page(text: str, page: int | None, headers: set[str], channel: Channel) -> tuple[list[tuple[int, str, str]], str]:
    """(line_no, kind, word) of what is found on a page, and its text as continuous paragraphs."""
    furniture, lines = read_page(text, page, headers, channel)
    found = [(i + 1, kind, "") for i, kind in furniture.items()]
    paragraphs, current, carried = [], [], ""
    for line in lines:
        if line is None:
            if current or carried:
                paragraphs.append(" ".join([*current, carried] if carried else current))
                current, carried = [], ""
            continue
        tokens = list(line.tokens)
        words = [line.plain[j] for j in line.decoded]
        for j, old, new in zip(line.decoded, words, channel.decode(words)):
            if new != old:
                found.append((line.number + 1, "misread", new))
                tokens[j] = _put(tokens[j], line.cores[j], new)
        for j, new in line.numbers.items():
            if not (j == 0 and line.carried):
                found.append((line.number + 1, "misread", new))
                tokens[j] = _put(tokens[j], line.cores[j], new)
        if line.carried:
            tokens[0] = carried + tokens[0][len(re.match(r"[^\W\d_]*(?:[^\W_]|[ऀ-ॣ'’-])*", tokens[0])[0]) :]
            carried = ""
        if line.broken is not None:
            word = channel.join(tokens[-1], line.broken)
            found.append((line.number + 1, "hyphen", word))
            bare = tokens[-1].lstrip("([\"'“")
            lead = tokens[-1][: len(tokens[-1]) - len(bare)]
            carried = lead + (word.capitalize() if bare[:1].isupper() else word)
            tokens = tokens[:-1]
        current += tokens
    if current or carried:
        paragraphs.append(" ".join([*current, carried] if carried else current))
    return sorted(set(found)), "\n\n".join(p for p in paragraphs if p)


def _put(token: str, old: str, new: str) -> str:
    at = token.lower().find(old)
    shaped = new.upper() if len(old) > 1 and token.isupper() else new.capitalize() if token[at : at + 1].isupper() else new
    return token[:at] + shaped + token[at + len(old) :] if at >= 0 else shaped


def _two_confusions(rates: dict[int, float], known: dict[int, bytes]):
    """Words that two confusions may have made a word of; ``known`` is a filter of the hashes of all words of their own right, so that few others come out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        logs = {k: math.log(r) for k, r in rates.items()}
        for batch in batches:
            rows = []
            for w in batch["word"]:
                best: dict[str, float] = {}
                for v, k in variants(w):
                    for u, l in variants(v):
                        p = logs[k] + logs[l]
                        if p > best.get(u, -math.inf):
                            best[u] = p
                for u, p in best.items():
                    h = zlib.crc32(u.encode()) % _BITS
                    bits = known.get(h >> 15)
                    if bits is not None and bits[(h >> 3) & 4095] >> (h & 7) & 1:
                        rows.append((w, u, p))
            yield pd.DataFrame(rows, columns=["word", "option", "log"])

    return run


def word_table(words: DataFrame) -> DataFrame:
    """(word, seen, own, options) of (word, seen): see Word. Every word of the corpus is in it, and judged by all counts.

    A word stands by its own right as often as it is seen, or never, if misreadings of more frequent words
    explain it. Its options are those that one confusion may have made it of, and stand more often by their
    own right; only for a word that has neither own right nor such an option, those of two confusions.
    """
    near = cut(words.select(F.col("word").alias("gram"), F.col("seen").alias("n")).mapInPandas(_explain, "read string, n_read long, gram string, confusion int").join(words.select(F.col("word").alias("gram"), F.col("seen").alias("n")), "gram"))
    errors = near.where("n_read > 0 and n >= 8 * n_read").groupBy("confusion").agg(F.sum("n_read").alias("errors"))
    chances = words.select(F.col("word").alias("gram"), F.col("seen").alias("n")).mapInPandas(_chances, "confusion int, chances long").groupBy("confusion").agg(F.sum("chances").alias("chances"))
    rates = dict.fromkeys(range(len(CONFUSIONS)), 1e-6) | {r["confusion"]: min(0.2, max(1e-6, r["errors"] / max(1, r["chances"]))) for r in errors.join(chances, "confusion").collect()}  # one row per confusion
    rate = F.element_at(F.create_map(*[F.lit(x) for k, r in rates.items() for x in (k, float(r))]), F.col("confusion"))
    mistaken = near.where("n > 4 * n_read").groupBy(F.col("read").alias("word")).agg(F.greatest(6 * F.sum(F.col("n") * rate), OWN_WORD * F.max("n")).alias("mistaken"))
    own = cut(words.join(mistaken, "word", "left").select("word", "seen", F.when(F.col("seen") > F.coalesce("mistaken", F.lit(0.0)), F.col("seen").cast("double")).otherwise(0.0).alias("own")))
    right = own.where("own > 0").select(F.col("word").alias("option"), F.col("seen").alias("option_seen"), F.col("own").alias("option_own"))
    once = (
        near.groupBy(F.col("read").alias("word"), F.col("gram").alias("option")).agg(F.max(F.log(rate)).alias("log"))
        .join(right, "option").join(own.select("word", "own"), "word").where("option_own > own").drop("own")
    )
    once = cut(once.select("word", "option", "log", "option_seen", "option_own"))
    place = F.crc32(F.col("option").cast("binary")) % _BITS
    known = {r["bucket"]: bytes(r["bits"]) for r in right.groupBy(F.shiftright(place, 15).cast("int").alias("bucket")).agg(F.expr(f"bitmap_construct_agg((crc32(cast(option as binary)) % {_BITS}) % 32768)").alias("bits")).collect()}  # of fixed size: 2 MB
    lost = own.where("own = 0 and length(word) > 3").join(once.select("word").distinct(), "word", "left_anti").select("word")
    twice = lost.mapInPandas(_two_confusions(rates, known), "word string, option string, log double").join(right, "option").select(once.columns)
    options = once.unionByName(twice).groupBy("word").agg(F.array_sort(F.collect_list(F.struct("option", "log", "option_seen", "option_own"))).alias("options"))  # at most what confusions allow
    return own.join(options, "word", "left")


#: The options of a word as one string, which is read quicker in a task than nested rows: a line each, of words without blanks.
_OPTIONS = "array_join(transform(options, o -> concat_ws(' ', o.option, cast(o.log as string), cast(o.option_seen as string), cast(o.option_own as string))), '\\n')"


@lru_cache(maxsize=100_000)
def _options(written: str) -> tuple:
    return tuple((o, float(p), int(seen), float(own)) for o, p, seen, own in (x.split(" ") for x in written.split("\n")))


def _word(seen, own, written: str | None) -> Word:
    return Word(int(seen), float(own), _options(written) if written else ())


def page_headers(pages: DataFrame) -> DataFrame:
    """(page_id, headers): keys of the running titles of each page.

    An edge line is one if it recurs in its file, or if it does so in RECURS of all files that have it. Titles
    of very many pages are joined where these are.
    """
    keys = cut(pages.where("file_path is not null").select("page_id", "file_path", "page_num", "page_content").mapInPandas(_edge_keys, "page_id string, file_path string, key string, narrow boolean"))
    in_file = keys.where("narrow").groupBy("file_path", "key").agg(F.count("*").alias("n"))
    known = in_file.groupBy("key").agg(F.avg((F.col("n") > 1).cast("double")).alias("recurs"))
    recurring = cut(in_file.join(known, "key").where((F.col("n") > 1) | (F.col("recurs") >= RECURS)).select("file_path", "key", "n"))
    titled = spread_join(keys.select("page_id", "file_path", "key"), recurring, ["file_path", "key"], F.col("n") >= max(1.0, HOT * pages.count()))
    return titled.groupBy("page_id").agg(F.collect_set("key").alias("headers"))  # at most the edge lines of a page


def repair_scanned(df: DataFrame) -> DataFrame:
    """(page_id, found, text) per page: what repair_page finds, and the repaired text.

    A page_id that comes again counts once. Pages of a null file are no file together. Null or empty content
    gives an empty page; without a page_num no page number is told. Counts cover all pages and all words: the
    frequent words, of which there are at most 1 / FREQUENT, go to the tasks, and each page gets its other
    words and the pairs that its line decoding asks for by joins, so that nothing that grows is sent about.
    """
    pages = cut(df.groupBy("page_id").agg(*[F.max(c).alias(c) for c in ("file_path", "page_num")], F.coalesce(F.max("page_content"), F.lit("")).alias("page_content")).where("page_id is not null"))
    grams = cut(pages.select("page_content").mapInPandas(_count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    single = ~F.contains("gram", F.lit(" "))
    sizes = grams.groupBy(single.alias("single")).agg(F.sum("n").alias("n")).collect()  # two rows
    total, pairs_total = ([r["n"] for r in sizes if r["single"] == which] or [1] for which in (True, False))
    total, pairs_total = max(1, total[0]), max(1, pairs_total[0])
    words = cut(word_table(grams.where(single).select(F.col("gram").alias("word"), F.col("n").alias("seen"))).select("word", "seen", "own", F.expr(_OPTIONS).alias("options")))
    often = F.col("seen") >= max(1.0, FREQUENT * total)
    frequent = {r["word"]: _word(r["seen"], r["own"], r["options"]) for r in words.where(often).collect()}  # at most 1 / FREQUENT
    shared = df.sparkSession.sparkContext.broadcast((frequent, total))

    def ask_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent = shared.value[0]
        for batch in batches:
            rows = []
            for key, text in zip(batch["page_id"], batch["page_content"]):
                asked = {w for t in set(text.split()) if (w := read_token(t)[0])} - sent.keys()
                asked.update(w for w in joins_of(text) if w not in sent)
                rows += [(key, w) for w in asked]
            yield pd.DataFrame(rows, columns=["page_id", "word"])

    asked = pages.select("page_id", "page_content").mapInPandas(ask_words, "page_id string, word string").join(words.where(~often), "word")  # none of them is hot
    rare = asked.groupBy("page_id").agg(F.collect_list(F.struct("word", "seen", "own", F.coalesce("options", F.lit("")).alias("options"))).alias("words"))  # at most the words of a page
    columns = ("word", "seen", "own", "options")
    rare = rare.select("page_id", *[F.col(f"words.{c}").alias(c) for c in columns])
    held = cut(pages.join(page_headers(pages), "page_id", "left").join(rare, "page_id", "left").select("page_id", "page_num", "page_content", "headers", *columns))

    def read(batch: pd.DataFrame) -> Iterator[tuple[str, str, int | None, set[str], Channel]]:
        sent, size = shared.value
        for key, page, text, headers, *of in zip(batch["page_id"], batch["page_num"], batch["page_content"], batch["headers"], *[batch[c] for c in columns]):
            known = {w: _word(*r) for w, *r in zip(*of)} if of[0] is not None else {}
            yield key, text, None if pd.isna(page) else int(page), set(headers) if headers is not None else set(), Channel(sent, size, known)

    def ask_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text, page, headers, channel in read(batch):
                _, lines = read_page(text, page, headers, channel)
                rows += [(key, g) for g in {g for line in lines if line for g in channel.asked_pairs([line.plain[j] for j in line.decoded])}]
            yield pd.DataFrame(rows, columns=["page_id", "gram"])

    asked_pairs = cut(held.mapInPandas(ask_pairs, "page_id string, gram string"))
    counted = spread_join(asked_pairs, grams.where(~single), ["gram"], F.col("n") >= max(1.0, HOT * pairs_total))
    pairs = counted.groupBy("page_id").agg(F.collect_list(F.struct("gram", "n")).alias("pairs")).select("page_id", F.col("pairs.gram").alias("grams"), F.col("pairs.n").alias("counts"))  # at most what a page asks for

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for (key, text, page, headers, channel), asked, counts in zip(read(batch), batch["grams"], batch["counts"]):
                channel.pairs = dict(zip(asked, counts.tolist())) if asked is not None else {}
                found, clean = repair_page(text, page, headers, channel)
                rows.append((key, [{"line_no": i, "kind": k, "word": w} for i, k, w in found], clean))
            yield pd.DataFrame(rows, columns=["page_id", "found", "text"])

    return held.join(pairs, "page_id", "left").mapInPandas(run, "page_id string, found array<struct<line_no:int,kind:string,word:string>>, text string")
