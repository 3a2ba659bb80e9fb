"""Text functions as Column to Column expressions, which stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdoc import lexicon


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """Line ends, runs of blanks, blanks between Devanagari letters, signs outside the kept class, blank lines. Null stays null."""
    x = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    x = F.regexp_replace(x, r"[ \t]+", " ")
    x = F.regexp_replace(x, r"([ऀ-ॿ])[ \t\n]+([ऀ-ॿ])", "$1$2")
    x = F.regexp_replace(x, r"[^a-zA-Z0-9_ \t\n.,\-/₹()%ऀ-ॿ]", "")
    x = F.regexp_replace(x, r"\n[ \t\n]*\n", "\n\n")
    return F.regexp_replace(x, r"^[ \t\n]+|[ \t\n]+$", "")


def devanagari_share(c: Column) -> Column:
    """Devanagari code points among Latin letters and those; null without letters."""
    return F.regexp_count(c, F.lit("[ऀ-ॿ]")) / F.nullif(F.regexp_count(c, F.lit("[a-zA-Zऀ-ॿ]")), F.lit(0))


#: The edge of a word, in both engines: anything but a letter, sign or digit.
_BEFORE, _AFTER = r"(?:^|[^\p{L}\p{M}\p{N}_])", r"(?:$|[^\p{L}\p{M}\p{N}_])"
_ASK_ENGLISH = r"|(?:इंग्लिश|अंग्रेजी|अंग्रेज़ी|अंगरेजी)\s*(?:में|मे)"


def asks_for(language: str, more: str = "") -> str:
    """Pattern of a request for an answer in a language, of lower-case text."""
    verbs = "reply|answer|respond|write|tell|explain"
    return (
        rf"{_BEFORE}(?:in\s+{language}|{language}\s*(?:me|mein|main|mai|maiin|please|plz|only)|(?:{verbs})\s+(?:in\s+)?{language}){_AFTER}|{language}\s*(?:में|मे){more}"
    )


def route_language(c: Column) -> Column:
    """en, hi-Latn or hi: an asked language first, then script, then Hinglish words."""
    x = F.lower(F.coalesce(c, F.lit("")))
    return (
        F.when(x.rlike(asks_for("english", _ASK_ENGLISH)), "en")
        .when(x.rlike(asks_for("hinglish")), "hi-Latn")
        .when(x.rlike(asks_for("hindi")), "hi")
        .when(x.rlike("[ऀ-ॿ]"), "hi")
        .when(x.rlike(rf"{_BEFORE}(?:{'|'.join(lexicon.HINGLISH)}){_AFTER}"), "hi-Latn")
        .otherwise("en")
    )


def is_follow_up(question: Column, short: int = 8) -> Column:
    """Whether a question needs the turn before it: it has few words, or a vague one."""
    vague = "|".join(sorted(lexicon.VAGUE))
    words = F.size(F.filter(F.split(question, r"\s+"), lambda w: w != ""))
    return (words <= short) | F.lower(question).rlike(vague)


def normalize_query(c: Column) -> Column:
    """Each spelling replaced in turn, in any case."""
    for wrong, right in lexicon.SPELLINGS:
        c = F.regexp_replace(c, f"(?i){wrong}", right)
    return c


def _once(c: Column, of) -> Column:
    """``of`` the column in lower case, which is made once however often ``of`` uses it."""
    return F.transform(F.array(F.lower(F.coalesce(c, F.lit("")))), of)[0]


def _holds(x: Column, words) -> Column:
    """Whether a text holds one of the words. A word that holds another needs no look of its own."""
    least = [w for w in dict.fromkeys(words) if not any(v != w and v in w for v in words)]
    found = x.contains(least[0])
    for w in least[1:]:
        found = found | x.contains(w)
    return found


def topics(c: Column) -> Column:
    """Topics of which some keyword stands in the text, in the order of the table."""
    return _once(c, lambda x: F.array_compact(F.array(*[F.when(_holds(x, words), F.lit(t)) for t, words in lexicon.TOPICS.items()])))


def tokens(c: Column) -> Column:
    """Distinct words of letters, digits and Devanagari signs, in lower case, without stop words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9_ऀ-ॿ]+"), F.lit(0)))
    return F.array_except(words, F.array(*[F.lit(w) for w in lexicon.STOPWORDS]))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 where one is empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def cited_rules(c: Column) -> Column:
    """Distinct numbers after "rule", "clause" or their Hindi words, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?:rule|ru1e|clause|section|chapter|नियम|खंड|अध्याय) ?(\d+)"), F.lit(1)))


def query_rules(c: Column) -> Column:
    """Rule numbers that a query names, up to a dot, and those that it means by a term of RULE_TERMS; distinct, in order."""
    named = F.lit(_BEFORE + r"(?:rule|clause|section|नियम|खंड)\s*(\p{Nd}[\p{L}\p{M}\p{N}_]*)")

    def found(x: Column) -> Column:
        numbers = F.filter(F.regexp_extract_all(x, named, F.lit(1)), lambda n: n.rlike(r"^\p{Nd}+$"))
        meant = F.array_compact(F.array(*[F.when(_holds(x, words), F.lit(r)) for r, words in lexicon.RULE_TERMS.items()]))
        return F.array_distinct(F.concat(numbers, meant))

    return _once(c, found)


MENTION = _BEFORE + r"(?:rule|clause|section|नियम|खंड|अध्याय)[-\s]*(\p{Nd}[\p{L}\p{M}\p{N}_]*)"


def mentioned_rules(c: Column) -> Column:
    """Distinct numbers of the rules, clauses, sections and chapters that a text mentions."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(MENTION), F.lit(1))
    return F.array_distinct(F.filter(found, lambda n: n.rlike(r"^\p{Nd}+$")))


CITATION = _BEFORE + r"((?:rule|ru1e|clause|section|chapter|नियम|खंड|अध्याय)(?:\s*\p{Nd}+(?:\.\p{Nd}+)*(?:\s*\([^)]+\))?|\s+[a-z][\p{L}\p{M}\p{N}_]*))"


def citations(c: Column) -> Column:
    """Distinct citations of rules, clauses, sections and chapters with dotted, bracketed or lettered numbers, in order; "Ru1e" is a misread "Rule"."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("(?i)" + CITATION), F.lit(1))
    whole = F.filter(found, lambda x: ~x.rlike(r"(?i)\s[a-z][\p{L}\p{M}\p{N}_]+$"))
    squeezed = F.transform(whole, lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+", " "), "(?i)^ru1e", "Rule"))
    return F.array_distinct(squeezed)


def misread_rule(r: Column) -> Column:
    """4xx for a rule 1xx that a scan may hold; null for others."""
    return F.when(r.rlike(r"^1\d\d$"), F.concat(F.lit("4"), F.substring(r, 2, 2)))


def pages(c: Column) -> Column:
    """Distinct page numbers that a text names, ascending."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?:Page|page|पृष्ठ) (\d+)"), F.lit(1))
    return F.array_sort(F.array_distinct(found.cast("array<int>")))


def marked_pages(c: Column) -> Column:
    """Distinct page numbers of the page markers of a text, whatever label follows them, ascending."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"---\s*[Pp]age\s*(\d+)(?:\s+[^\n]*?)?\s*---"), F.lit(1))
    return F.array_sort(F.array_distinct(found.cast("array<int>")))


def snippet_key(c: Column) -> Column:
    """Letters and digits of a text in lower case, by which snippets are found in pages."""
    return F.lower(F.regexp_replace(c, "[^a-zA-Z0-9ऀ-ॿ]", ""))


def last_index(c: Column, part: str) -> Column:
    """0-based place of the last occurrence; -1 if there is none."""
    at = F.instr(F.reverse(c), part[::-1])
    return F.when(at == 0, -1).otherwise(F.length(c) - at - len(part) + 1)


def truncate(c: Column, most: int = lexicon.CHUNK_CHARS) -> Column:
    """At most ``most`` characters, cut at a paragraph or else a sentence that ends in the last 500."""
    head = F.substring(c, 1, most)
    paragraph = last_index(head, "\n\n")
    ends = F.greatest(*[F.when(last_index(head, e) > most - 500, last_index(head, e) + len(e) - 1).otherwise(-1) for e in lexicon.SENTENCE_ENDS])
    return F.when(F.length(c) <= most, c).when(paragraph > most - 500, strip(F.substring(head, F.lit(1), paragraph))).when(ends != -1, strip(F.substring(head, F.lit(1), ends + 1))).otherwise(strip(head))


def point_key(c: Column) -> Column:
    """Name-based UUID, version 5, of the DNS namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8")), F.encode(c, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab89ab89ab89ab"]), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def feedback(c: Column) -> Column:
    """satisfied, unsatisfied or neutral, whatever its spelling; null and others are neutral."""
    x = F.lower(strip(c))
    return F.when(x.isin("satisfied", "unsatisfied"), x).otherwise("neutral")


def display_source(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)\.(docx|txt)$", ".pdf")


def toggled(members: Column, items: Column) -> Column:
    """A list without those of the items that are in it, and with those that are not."""
    return F.concat(F.array_except(members, items), F.array_except(items, members))
