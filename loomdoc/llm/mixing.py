"""Problem 8: mixing sources to target weights by balanced sampling.

Each source gets as many copies of its documents as its share of the largest feasible total asks for:
whole rounds of all its documents and a fractional round. The fractional round is drawn with the cube
method: inclusion probabilities move through the null space of the balancing constraints, number and
tokens of documents, until all but two of a block are decided; what is left of the blocks flies again
together, until two documents a source remain. The landing gives up the balance of tokens and then that of
number, so that inclusion probabilities hold throughout; the smallest documents are left for it.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdoc.session import cut

BLOCK = 5000
_EDGE = 1e-9


def decided(p: np.ndarray) -> np.ndarray:
    """Probabilities with those that are 0 or 1 but for rounding made so."""
    return np.where(p < _EDGE, 0.0, np.where(p > 1 - _EDGE, 1.0, p))


def flight(p: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Inclusion probabilities after the flight: all but at most two are 0 or 1; number and tokens expected stay the same."""
    p = decided(p)
    scale = sizes / max(1.0, float(sizes.mean()) if len(sizes) else 1.0)
    active: list[int] = []
    for i in np.flatnonzero((p > 0) & (p < 1)).tolist():
        active.append(i)
        if len(active) < 3:
            continue
        a, b, c = (scale[j] for j in active)
        move = np.array([c - b, a - c, b - a])  # null vector of the rows (1, 1, 1) and (a, b, c)
        if not move.any():
            move = np.array([1.0, -1.0, 0.0])
        p[active] = _step(p[active], move, rng)
        active = [j for j in active if 0 < p[j] < 1]
    return p


def _step(x: np.ndarray, move: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities moved along ``move`` to one of the two faces of the cube, so that their expectation stays."""
    up = min((1 - v) / m if m > 0 else -v / m for v, m in zip(x, move) if m)
    down = min(v / m if m > 0 else (v - 1) / m for v, m in zip(x, move) if m)
    return decided(x + up * move if rng.random() * (up + down) < down else x - down * move)


def land(p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decides the documents that the last flight left: first with their number kept, then the last by its probability."""
    p = decided(p)
    open_ = np.flatnonzero((p > 0) & (p < 1)).tolist()
    while len(open_) > 1:
        p[open_[:2]] = _step(p[open_[:2]], np.array([1.0, -1.0]), rng)
        open_ = [j for j in open_ if 0 < p[j] < 1]
    for j in open_:
        p[j] = float(rng.random() < p[j])
    return p


def _fly(seed: str, level: int, last: bool):
    def fly(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["tokens", "_k"], ascending=[False, True]).reset_index(drop=True)  # the smallest are left for the landing
        name = f"{seed}|{group['source'].iloc[0]}|{group['_block'].iloc[0]}|{level}"
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big"))
        sizes = group["tokens"].to_numpy(dtype=float)
        p = flight(group["p"].to_numpy(dtype=float), sizes, rng)
        group["p"] = land(p, rng) if last else p
        return group

    return fly


def mix(sized: DataFrame, targets: DataFrame, key: str, seed: str = "mix", block: int = BLOCK) -> DataFrame:
    """(key, source, tokens, copies, expected) of every document of the target sources; 0 copies are left out of the mix.

    ``expected`` is the mean number of copies over all draws, which the cube method keeps: the same for all documents of a source.

    ``sized`` is (key, source, tokens), ``targets`` (source, target_share, max_repeats), a few rows. The total
    is the largest at which no document of any source is used more than ``max_repeats`` times. A source
    without tokens and nulls in a target's columns take that target out, null keys or sources a document.
    """
    wanted = F.broadcast(targets.where("source is not null and target_share > 0 and max_repeats > 0").select("source", "target_share", "max_repeats"))
    docs = cut(sized.where(F.col(key).isNotNull()).join(wanted, "source").select(F.col(key).alias("_k"), "source", "tokens", "target_share", "max_repeats"))
    totals = docs.groupBy("source").agg(F.sum("tokens").alias("have"), F.count("*").alias("n"), F.first("target_share").alias("share"), F.first("max_repeats").alias("most")).where("have > 0").collect()  # a row per target
    if not totals:
        return docs.where("false").select(F.col("_k").alias(key), "source", "tokens", F.lit(0).alias("copies"), F.lit(0.0).alias("expected"))
    whole = sum(r["share"] for r in totals)
    total = min(r["most"] * r["have"] / (r["share"] / whole) for r in totals)
    spark = sized.sparkSession
    rates = {r["source"]: min(float(r["most"]), r["share"] / whole * total / r["have"]) for r in totals}
    plan = spark.createDataFrame([(s, int(r + _EDGE), max(0.0, r - int(r + _EDGE))) for s, r in rates.items()], "source string, rounds int, p double")
    n = max(r["n"] for r in totals)
    units = docs.join(F.broadcast(plan), "source").select("_k", "source", "tokens", "rounds", "p", (F.col("rounds") + F.col("p")).alias("expected"), F.pmod(F.xxhash64("_k"), F.lit(max(1, math.ceil(n / block)))).cast("long").alias("_block"))
    schema = units.schema.simpleString().removeprefix("struct<").removesuffix(">")
    blocks, done = max(1, math.ceil(n / block)), []
    while True:
        last = blocks == 1

        units = cut(units.groupBy("source", "_block").applyInPandas(_fly(seed, len(done), last), schema))
        done.append(units.where("p = 0 or p = 1"))
        if last:
            break
        blocks = math.ceil(blocks / (block // 4))
        units = units.where("p > 0 and p < 1").withColumn("_block", F.pmod(F.xxhash64("_block", F.lit("again")), F.lit(blocks)).cast("long"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(F.col("_k").alias(key), "source", "tokens", (F.col("rounds") + F.col("p").cast("int")).alias("copies"), "expected")


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, expected_tokens, documents, used, most_copies, max_repeats) per target source."""
    by = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.round(F.sum(F.col("tokens") * F.col("expected")), 3).alias("expected_tokens"), F.count("*").alias("documents"), F.count_if(F.col("copies") > 0).alias("used"), F.max("copies").alias("most_copies"))
    total = by.agg(F.sum("tokens").alias("total"))
    return F.broadcast(targets).join(by, "source", "left").crossJoin(F.broadcast(total)).select(
        "source", "target_share", F.round(F.coalesce("tokens", F.lit(0)) / F.col("total"), 6).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("expected_tokens", F.lit(0.0)).alias("expected_tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats",
    )
