"""Query log, feedback, sessions and usage measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdoc import lexicon
from loomdoc.functions import text as T


def once(log: DataFrame) -> DataFrame:
    """One row per id of a log whose rows may be delivered twice: the one received last."""
    rest = [c for c in log.columns if c != "id"]
    return log.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("received_at", F.coalesce("response", F.lit("")), F.coalesce("query", F.lit("")))).alias("r")).select("id", "r.*")


def without_phrase(log: DataFrame, phrase: str) -> DataFrame:
    """The entries whose question is not ``phrase``, in any case and between any blanks; a null question is none."""
    return log.where(F.upper(F.trim(F.coalesce("query", F.lit("")))) != phrase.upper())


def with_feedback(log: DataFrame, events: DataFrame) -> DataFrame:
    """(id, feedback, updates): each entry of ``log`` with the last valid feedback of ``events`` (id, feedback, at), neutral without one.

    Only the three known values are feedback, in any spelling; events of unknown entries change nothing.
    """
    said = F.lower(T.strip(F.col("feedback")))
    last = events.where(said.isin("neutral", "satisfied", "unsatisfied")).groupBy("id").agg(F.max_by(said, "at").alias("feedback"), F.count("*").alias("updates"))
    return log.select("id").join(last, "id", "left").select("id", F.coalesce("feedback", F.lit("neutral")).alias("feedback"), F.coalesce("updates", F.lit(0)).alias("updates"))


def response_seconds(c: Column) -> Column:
    """The response time, or null where it cannot be one."""
    return F.when((c >= 0) & (c < 3600), c)


def usage(log: DataFrame, by: list[str]) -> DataFrame:
    """Counts, mean response time and satisfaction of rated answers; 100 where none is rated."""
    fb = T.feedback(F.col("feedback"))
    sat, uns = F.count_if(fb == "satisfied"), F.count_if(fb == "unsatisfied")
    return log.groupBy(*by).agg(
        F.count("*").alias("total_queries"),
        F.coalesce(F.round(F.avg(response_seconds(F.col("response_time_seconds"))), 2), F.lit(0.0)).alias("avg_response_time"),
        sat.alias("satisfied_count"), uns.alias("unsatisfied_count"), (sat + uns).alias("rated_count"),
        F.when(sat + uns > 0, F.round(sat * 100.0 / (sat + uns), 1)).otherwise(100.0).alias("satisfaction_rate"),
    )


def top_terms(log: DataFrame, text: str, k: int) -> DataFrame:
    """The k most frequent words of three letters or more; ties by word."""
    words = log.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-zA-Zऀ-ॿ]{3,}"), F.lit(0))).alias("term"))
    return words.where(~F.col("term").isin(*lexicon.TERM_STOPWORDS)).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(k)


def sessionize(events: DataFrame, user: str, ts: str, gap: str = "1 hour") -> DataFrame:
    """(user, session_start, session_end, events): a session ends after a gap longer than ``gap``."""
    return events.where(F.col(user).isNotNull() & F.col(ts).isNotNull()).groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count("*").alias("events"))


def last_turns(log: DataFrame, session: str, order: list[Column], n: int) -> DataFrame:
    """The last n rows of each session, numbered from the newest. The rank is limited before the shuffle."""
    return log.withColumn("back", F.row_number().over(Window.partitionBy(session).orderBy(*order))).where(F.col("back") <= n)
