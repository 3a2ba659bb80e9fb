"""Set-similarity join by prefix filtering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _hashed() -> Column:
    return F.array_sort(F.transform("tokens", lambda t: F.xxhash64(t)))


def _class(c: str) -> Column:
    """What a set is told apart by: 128 bits of it, so that no two different sets are ever taken for one."""
    return F.md5(F.array_join(F.col(c), ","))


def _classes(df: DataFrame, key: Column) -> DataFrame:
    """(c, k, set): one row per set of tokens, which are hashed; ``key`` folds the keys of the rows that have it."""
    return df.where("key is not null and size(tokens) > 0").select("key", _hashed().alias("set")).groupBy("set").agg(key.alias("k")).select(_class("set").alias("c"), "k", "set")


def _near(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(cl, kl, cr, kr, similarity) of the pairs of classes of at least ``threshold``; a pair comes once or more.

    Pairs are judged where they meet: no candidate is shuffled. After the i-th and j-th tokens as the
    first in common no more than the shorter rest can be, which drops most candidates by their places.
    """
    counts = left.select("set").unionByName(right.select("set")).select(F.explode("set").alias("t")).groupBy("t").agg(F.count("*").alias("n"))

    def prefixes(df: DataFrame, name: str) -> DataFrame:
        ranked = df.select("c", "k", F.explode("set").alias("t")).join(counts, "t").groupBy("c").agg(F.first("k").alias("k"), F.array_sort(F.collect_list(F.struct("n", "t"))).alias("by"))
        size = F.size("by")
        first = F.slice("by.t", F.lit(1), size - F.ceil(F.lit(threshold) * size - 1e-9).cast("int") + 1)
        return ranked.select(F.col("c").alias(f"c{name}"), F.col("k").alias(f"k{name}"), F.col("by.t").alias(f"s{name}"), F.posexplode(first).alias(f"p{name}", "t"))

    nl, nr = F.size("sl"), F.size("sr")
    least = F.lit(threshold / (1 + threshold)) * (nl + nr) - 1e-9
    both = F.size(F.array_intersect("sl", "sr"))
    met = prefixes(left, "l").join(prefixes(right, "r"), "t").where(F.least(nl - F.col("pl"), nr - F.col("pr")) >= least).where(both >= least)
    return met.select("cl", "kl", "cr", "kr", (both / (nl + nr - both)).alias("similarity")).where(F.col("similarity") >= threshold)


def jaccard_join(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(l, r, similarity) for all pairs of (key, tokens) rows with Jaccard of at least ``threshold``; none is lost.

    Sets meet on their rarest tokens only: two sets that similar share one of their first
    size - ceil(threshold * size) + 1 tokens in order of frequency, so that frequent tokens make no
    candidates. Equal sets are joined as one class. Empty sets and null keys have no partner.
    """
    near = _near(_classes(left, F.lit(None)), _classes(right, F.lit(None)), threshold).select("cl", "cr", "similarity").dropDuplicates(["cl", "cr"])
    sides = {}
    for name, df in (("l", left), ("r", right)):
        sides[name] = df.where("key is not null and size(tokens) > 0").select(F.col("key").alias(name), _hashed().alias("set")).select(name, _class("set").alias(f"c{name}"))
    return near.join(sides["l"], "cl").join(sides["r"], "cr").select("l", "r", "similarity")


def nearest_set(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(id, question_id, similarity): for each left key the most similar right key of at least ``threshold``, the smallest of equals.

    Equal sets count once on both sides, the right ones with their smallest key, so that copies are
    given the best key of their set and not paired with one another.
    """
    near = _near(_classes(left, F.lit(None)), _classes(right, F.min("key")), threshold)
    best = near.groupBy(F.col("cl").alias("c")).agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("kr").alias("q"))).alias("best"))
    keys = left.where("key is not null and size(tokens) > 0").select("key", _hashed().alias("set")).select("key", _class("set").alias("c"))
    least = keys.join(best, "c").groupBy(F.col("key").alias("id")).agg(F.min("best").alias("best"))
    return least.select("id", F.col("best.q").alias("question_id"), F.round(-F.col("best.s"), 6).alias("similarity"))
