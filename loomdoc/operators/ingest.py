"""From documents to keyed chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdoc import lexicon

SEPARATORS = ("\n\n", "\n", "। ", ". ", " ", "")


def stride_chunks(df: DataFrame, key: str, source: str, text: str, size: int = lexicon.CHUNK_SIZE, overlap: int = lexicon.CHUNK_OVERLAP) -> DataFrame:
    """(key, chunk_index, total_chunks, chunk_key, chunk): windows of ``size`` characters that overlap. Null and empty texts have none."""
    step = size - overlap
    total = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / F.lit(float(step))).cast("int"))
    windows = df.where(F.col(text) != "").select(key, source, text, total.alias("total_chunks")).withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.col("total_chunks") - 1)))
    return windows.select(
        key, "chunk_index", "total_chunks", F.format_string("%s_%s_chunk_%04d", source, F.col(key).cast("string"), "chunk_index").alias("chunk_key"),
        F.substring(F.col(text), F.col("chunk_index") * step + 1, F.lit(size)).alias("chunk"),
    )


def split_recursive(text: str, size: int = lexicon.CHUNK_SIZE, overlap: int = lexicon.CHUNK_OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size``, cut at the coarsest separator that serves; each begins with up to ``overlap`` of the one before."""
    at = next(i for i, s in enumerate(separators) if not s or s in text)
    separator, finer = separators[at], separators[at + 1 :]
    parts = text.split(separator) if separator else list(text)
    out: list[str] = []
    fit: list[str] = []

    def flush() -> None:
        window: list[str] = []
        total = 0
        for p in fit:
            more = len(p) + (len(separator) if window else 0)
            if window and total + more > size:
                out.append(separator.join(window).strip())
                while window and (total > overlap or total + more > size):
                    total -= len(window.pop(0)) + (len(separator) if window else 0)
            window.append(p)
            total += len(p) + (len(separator) if len(window) > 1 else 0)
        if window:
            out.append(separator.join(window).strip())
        fit.clear()

    for p in parts:
        if len(p) <= size:
            fit.append(p)
        else:
            flush()
            out.extend(split_recursive(p, size, overlap, finer))
    flush()
    return [p for p in out if p]


def recursive_chunks(df: DataFrame, key: str, text: str, size: int = lexicon.CHUNK_SIZE, overlap: int = lexicon.CHUNK_OVERLAP) -> DataFrame:
    """(key, chunk_index, total_chunks, chunk) by recursive splitting. Null and blank texts have none."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, len(cs), c) for k, t in zip(batch["_k"], batch["_t"]) for cs in [split_recursive(t, size, overlap)] for i, c in enumerate(cs)]
            yield pd.DataFrame(rows, columns=["_k", "chunk_index", "total_chunks", "chunk"])

    return df.where(F.col(text).rlike(r"\S")).select(F.col(key).alias("_k"), F.col(text).alias("_t")).mapInPandas(run, f"_k {kind}, chunk_index int, total_chunks int, chunk string").withColumnRenamed("_k", key)


def merged_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, paragraphs): layout lines joined to the one before, unless a bullet or rule starts them or the one before ends a sentence. A fold over the lines, in the JVM."""
    lines = F.transform(F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r", ""), "\n"), lambda x: F.trim(x))
    empty = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))
    starts = lambda x: x.rlike(r"^(?:[-*•▪●]|\d+[.)]|\(?[a-z]\)|Rule |नियम )")

    def step(s, x):
        closed = F.when(s["cur"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["cur"])))
        apart = (s["cur"] == "") | starts(x) | s["cur"].rlike(r"[.!?।:]$")
        return F.when(x == "", F.struct(F.lit("").alias("cur"), closed.alias("out"))).when(apart, F.struct(x.alias("cur"), closed.alias("out"))).otherwise(F.struct(F.concat_ws(" ", s["cur"], x).alias("cur"), s["out"].alias("out")))

    folded = F.aggregate(lines, empty, step, lambda s: F.when(s["cur"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["cur"]))))
    return df.select(key, folded.alias("paragraphs"))


#: Where a sentence ends: after its mark, but not after a short form or a single digit, and at line breaks.
SENTENCE_END = r"(?<!\bRs\.)(?<!\bNo\.)(?<!\bDr\.)(?<!\bM/s\.)(?<!\b\d\.)(?<=[.!?।])\s+|\n+"


def answer_events(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, seq, type, text): each answer cut into its sentences between a start and an end. Null answers only start and end."""
    said = F.filter(F.split(F.coalesce("_t", F.lit("")), SENTENCE_END), lambda x: x.rlike(r"\S"))
    of = lambda kind, x: F.struct(F.lit(kind).alias("type"), x.alias("text"))
    events = F.concat(F.array(of("start", F.lit(""))), F.transform(said, lambda x: of("token", x)), F.array(of("done", F.lit(""))))
    one = df.groupBy(F.col(key).alias("_k")).agg(F.max(text).alias("_t"))
    return one.select(F.col("_k").alias(key), F.posexplode(events).alias("seq", "e")).select(key, "seq", "e.type", "e.text")


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last by ``order``: an upsert of what was ingested again. Null keys are one key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(order).isNotNull(), order, *[F.col(c).cast("string") for c in rest if c != order])).alias("_row")).select(key, "_row.*")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both, a new one in place of an old one of its key."""
    return latest(old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1))), key, "_batch").drop("_batch")
