"""Problem 5: lines that recur across the documents of one source.

Lines become token templates in fixed-depth trees: source, number of tokens, first or last token. The trees
are kept as counted rows, so that partial trees of all partitions merge in one aggregation. Wildcard slots
are numbers, dates and times, tokens of a leaf that are names by their capitals, and runs of tokens that
vary as names do while the rest of the line stands; templates that cover a large share of their source's documents are
the repeated lines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdoc.operators.ranking import spread_join
from loomdoc.session import cut

#: Month names that dates are written with.
MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?|जनवरी|फरवरी|फ़रवरी|मार्च|अप्रैल|मई|जून|जुलाई|अगस्त|सितंबर|सितम्बर|अक्टूबर|अक्तूबर|नवंबर|नवम्बर|दिसंबर|दिसम्बर"
_NUMBER = re.compile(r"[0-9०-९]+(?:[-/.:,][0-9०-९]+)*(?: ?[ap]\.?m\b\.?)?")
_DATE = re.compile(rf"<\*>(?:st|nd|rd|th)? (?:{MONTHS})\.?,? <\*>|\b(?:{MONTHS})\.? <\*>,? <\*>")
_BULLET = re.compile(r"(?:[•◦‣▪●○■►*·»>–—-]+ ?|\(?<\*>[.)] )")
_STOP = " .। "
#: A run of two to RUN tokens is a slot of names if it takes VALUES different values while the rest of the line stands, and if its
#: first and its last tokens both vary and recombine, as given and family names do: no more than MIXED of the values differ in either.
RUN, VALUES, MIXED = 4, 8, 0.8
#: Share of all documents above which a source, line or template is hot: there are at most (lines per document) / HOT of them.
HOT = 0.001


def plain_line(line: str) -> str:
    """The line without what may differ between alike lines, but for names: case, spacing, a leading bullet, a final full stop, dates, times, numbers."""
    x = " ".join(line.lower().split())
    y = _NUMBER.sub("<*>", x)
    if y != x:
        y = _DATE.sub("<*>", y)
    if y[:1] and not y[0].isalpha():
        y = _BULLET.sub("", y, count=1) if _BULLET.match(y) else y
    return y.rstrip(_STOP)


def _marks(line: str, plain: str) -> str | None:
    """Per token of the plain line, whether it starts with a capital; nothing where the line is in one case or its tokens differ."""
    if line.islower() or line.isupper():
        return None
    words = _NUMBER.sub("0", line).split()
    size = plain.count(" ") + 1
    if len(words) == size + 1 and not words[0][0].isalnum():
        words = words[1:]
    if len(words) != size:
        words = _DATE.sub("0", _NUMBER.sub("<*>", " ".join(words).lower())).split() and re.sub(rf"0 (?i:{MONTHS})\.?,? 0", "0", " ".join(words)).split()
        if len(words) != size:
            return None
    return "".join("1" if any(x[:1].isupper() for x in w.lstrip("(\"'“").split("-")) else "0" for w in words)


def _leaves(plain: str) -> tuple[str, str]:
    """The two leaves of a line: by its number of tokens and its first, and by their number and the last."""
    size = plain.count(" ") + 1
    return f"{size} {plain.partition(' ')[0]}", f"{size} ~ {plain.rpartition(' ')[2]}"


def _count_leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        seen: Counter = Counter()
        for source, text in zip(batch["_source"], batch["_text"]):
            for line in text.split("\n"):
                if plain := plain_line(line):
                    first, last = _leaves(plain)
                    seen[source, first] += 1
                    seen[source, last] += 1
        yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["_source", "_leaf", "_n"])


def skeletons(template: str) -> list[tuple[str, str]]:
    """(line with a run of tokens as one slot, the run) for every run of two to RUN tokens beside which a word stands."""
    words = template.split(" ")
    out = []
    for i in range(len(words)):
        for k in range(2, min(RUN, len(words) - i) + 1):
            left, right = words[:i], words[i + k :]
            if any(w[0].isalpha() for w in (*left, *right)):
                out.append((" ".join([*left, "<+>", *right]), " ".join(words[i : i + k])))
    return out


def _mask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(s, line, n, k, f) for s, line, t, n in zip(batch["_source"], batch["_line"], batch["_exact"], batch["_n"]) for k, f in skeletons(t)]
        yield pd.DataFrame(rows, columns=["_source", "_line", "_n", "template", "_filler"])


def _candidates(base: DataFrame, totals: DataFrame, kind: str, documents: int) -> DataFrame:
    """Lines that stand in a leaf which could reach the threshold even if all its lines were alike; they leave out nearly all body text.

    Leaves of hot sources, of which there are at most 1 / HOT with 2 (lines per document) / share leaves each, go to the
    tasks; lines of the other sources meet theirs by a shuffle.
    """
    leaves = cut(
        base.select("_source", "_text").mapInPandas(_count_leaves, "_source string, _leaf string, _n long")
        .groupBy("_source", "_leaf").agg(F.sum("_n").alias("_n"))
        .join(totals, "_source").where("_n >= _need").select("_source", "_leaf", "_docs")
    )
    hot = F.col("_docs") >= max(1.0, HOT * documents)
    sources = {r["_source"] for r in totals.where(hot).select("_source").collect()}  # at most 1 / HOT
    known = base.sparkSession.sparkContext.broadcast((sources, {(r["_source"], r["_leaf"]) for r in leaves.where(hot).collect()}))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        big, full = known.value
        for batch in batches:
            rows = []
            for key, source, text in zip(batch["_key"], batch["_source"], batch["_text"]):
                sure = source in big
                for no, line in enumerate(text.split("\n"), 1):
                    if plain := plain_line(line):
                        first, last = _leaves(plain)
                        if not sure or (source, first) in full or (source, last) in full:
                            rows.append((key, source, no, plain, _marks(line, plain), sure, [first, last]))
            yield pd.DataFrame(rows, columns=["_key", "_source", "_no", "_plain", "_marks", "_sure", "_leaves"])

    columns = ["_key", "_source", "_no", "_plain", "_marks"]
    lines = cut(base.mapInPandas(parse, f"_key {kind}, _source string, _no int, _plain string, _marks string, _sure boolean, _leaves array<string>"))
    rest = lines.where("not _sure").select(*columns, F.explode("_leaves").alias("_leaf")).join(leaves.where(~hot), ["_source", "_leaf"], "left_semi").select(*columns).distinct()
    return lines.where("_sure").select(*columns).unionByName(rest)


def _templates(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """(line, template): each distinct candidate line with its exact template, and with those of its skeletons whose slot is one of names."""
    counted = kept.groupBy("_source", "_line", "_plain", "_marks").agg(F.count("*").alias("_n"))
    words = F.split("_plain", " ")
    tokens = counted.select("_source", "_line", "_n", F.concat_ws(" ", F.size(words), words[0]).alias("_leaf"), F.posexplode(words).alias("_pos", "_token"), "_marks").withColumn("_capital", F.substring("_marks", F.col("_pos") + 1, F.lit(1)).cast("int"))
    place = ["_source", "_leaf", "_pos", "_token"]
    named = (
        tokens.where("_pos > 0 and not contains(_token, '<*>')")
        .groupBy(*place)
        .agg(F.sum(F.when(F.col("_capital").isNotNull(), F.col("_n"))).alias("_cased"), F.sum(F.col("_capital") * F.col("_n")).alias("_capitals"))
        .where("_capitals >= 0.5 * _cased")
        .select(*place, F.lit("<name>").alias("_slot"))
    )
    exact = (
        tokens.join(named, place, "left")
        .groupBy("_source", "_line")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("_pos", F.coalesce("_slot", "_token").alias("t")))), lambda x: x.t), " ").alias("_exact"), F.max("_n").alias("_n"))
    )
    exact = cut(exact)
    masked = exact.mapInPandas(_mask, "_source string, _line long, _n long, template string, _filler string")
    slots = (
        masked.groupBy("_source", "template", "_filler").agg(F.sum("_n").alias("_n"))
        .groupBy("_source", "template").agg(F.count("*").alias("_values"), F.sum("_n").alias("_n"), F.countDistinct(F.substring_index("_filler", " ", 1)).alias("_first"), F.countDistinct(F.substring_index("_filler", " ", -1)).alias("_last"))
        .where((F.col("_values") >= VALUES) & (F.least("_first", "_last") >= 3) & (F.greatest("_first", "_last") <= MIXED * F.col("_values"))).join(totals, "_source").where("_n >= _need").select("_source", "template")
    )
    varied = masked.select("_source", "_line", "template").join(slots, ["_source", "template"]).select("_line", "template").distinct()
    return exact.select("_line", F.col("_exact").alias("template")).unionByName(varied)


def repeated_lines(df: DataFrame, key: str, source: str, content: str, share: float = 0.1, least: int = 3) -> DataFrame:
    """(key, line_no, source, template, documents) of every line that has a template which stands in ``share`` of its source's documents and in ``least``.

    Of several such templates of a line the one in most documents comes out. A key that comes again counts
    once. Null key, source or content and blank lines give no row. Lines and templates that very many
    documents hold are joined where they are (spread_join), all others by a shuffle.
    """
    kind = df.schema[key].dataType.simpleString()
    base = df.select(F.col(key).alias("_key"), F.col(source).cast("string").alias("_source"), F.col(content).alias("_text")).where("_key is not null and _source is not null and _text is not null")
    totals = cut(base.select("_source", "_key").distinct().groupBy("_source").agg(F.count("*").alias("_docs")).withColumn("_need", F.greatest(F.ceil(F.col("_docs") * share - 1e-6), F.lit(least))))
    documents = totals.agg(F.coalesce(F.sum("_docs"), F.lit(0))).first()[0]
    kept = _candidates(base, totals, kind, documents).withColumn("_line", F.xxhash64("_source", "_plain"))
    of_line = kept.groupBy("_line").agg(F.count("*").alias("_rows"))
    templates = cut(_templates(kept, totals).join(of_line, "_line").groupBy("_line").agg(F.collect_set("template").alias("_templates"), F.first("_rows").alias("_rows")))  # one, and the slots of a line
    common = lambda n: F.col(n) >= max(1.0, HOT * documents)
    lines = kept.select("_key", "_no", "_source", "_line")
    parsed = cut(spread_join(lines, templates, ["_line"], common("_rows")).select("_key", "_no", "_source", F.explode("_templates").alias("template")))
    covering = (
        parsed.select("_source", "template", "_key").distinct().groupBy("_source", "template").agg(F.count("*").alias("documents"))
        .join(totals, "_source").where("documents >= _need").select("_source", "template", "documents")
    )
    found = spread_join(parsed, cut(covering), ["_source", "template"], common("documents"))
    best = F.max(F.struct("documents", "template"))
    return found.groupBy("_key", "_no", "_source").agg(best.alias("b")).select(F.col("_key").alias(key), F.col("_no").alias("line_no"), F.col("_source").alias("source"), "b.template", "b.documents")


def without_repeated_lines(df: DataFrame, key: str, source: str, content: str, share: float = 0.1, least: int = 3) -> DataFrame:
    """(key, content without its repeated lines, removed): one row per key; all other lines are kept as they stand."""
    found = repeated_lines(df, key, source, content, share, least).groupBy(key).agg(F.collect_set("line_no").alias("_gone"))
    once = df.groupBy(key).agg(F.max(content).alias(content))
    kept = F.filter(F.split(content, "\n"), lambda _, i: ~F.array_contains("_gone", (i + 1).cast("int")))
    return once.join(found, key, "left").select(
        key, F.when(F.col("_gone").isNull(), F.col(content)).otherwise(F.array_join(kept, "\n")).alias(content), F.coalesce(F.size("_gone"), F.lit(0)).alias("removed")
    )
