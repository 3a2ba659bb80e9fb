"""Exact nearest neighbours in blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _blocks(df: DataFrame, key: str, vector: str, size: int, name: str) -> DataFrame:
    """Rows of at most about ``size`` vectors each, by hash of the key."""
    n = max(1, math.ceil(df.count() / size))
    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias("b")).agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col(vector).alias("v"))).alias(name)).drop("b")


def nearest(points: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10, block: int = 2048) -> DataFrame:
    """(query_key, key, similarity, rank): the k points of highest cosine for each query, ties by key.

    Blocks of queries meet blocks of points, each pair one matrix product, so that neither side is
    broadcast; what is ranked at the end is k rows per query and block of points. Null vectors are left
    out, zero vectors are similar to nothing (0), and an empty side gives no row.
    """
    kind = points.schema[key].dataType.simpleString()
    pairs = _blocks(queries, key, vector, block, "qs").hint("shuffle_replicate_nl").crossJoin(_blocks(points, key, vector, block, "ps"))

    def unit(rows) -> tuple[list, np.ndarray]:
        m = np.array([r["v"] for r in rows], dtype=np.float64)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return [r["k"] for r in rows], np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    def top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for qs, ps in zip(batch["qs"], batch["ps"]):
                qk, qm = unit(qs)
                pk, pm = unit(ps)
                order = np.argsort(np.array(pk))
                pk = np.array(pk)[order]
                sims = np.round(qm @ pm[order].T, 6)
                best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                yield pd.DataFrame({"query_key": np.repeat(qk, best.shape[1]), "key": pk[best].ravel(), "similarity": np.take_along_axis(sims, best, 1).ravel()})

    near = pairs.mapInPandas(top, f"query_key {kind}, key {kind}, similarity double")
    by = Window.partitionBy("query_key").orderBy(F.desc("similarity"), "key")
    return near.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
