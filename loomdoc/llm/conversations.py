"""Problem 3: conversations from message rows.

Rows that carry a session are grouped by it. Rows without one are linked by what they reply to and quote;
connected components over those links, found with alternating large-star and small-star joins, stand in
for the session. Conversations are then ordered and checked with window functions over bounded ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc.operators.ranking import spread_positions
from loomdoc.session import cut

#: What stands in for a missing message.
STAND_INS = ("null", "none", "nan", "nil", "n/a", "na", "nat", "undefined", "unknown", "[]", "{}", '""', "''", "<na>", "(null)", "(none)", "(empty)")


def present(text: Column) -> Column:
    """The message, or null where it is blank or a stand-in."""
    bare = F.lower(F.regexp_replace(text, r"^[\s\x{A0}\x{200B}-\x{200F}\x{FEFF}]+|[\s\x{A0}\x{200B}-\x{200F}\x{FEFF}]+$", ""))
    return F.when(bare.rlike(r"[\p{L}\p{N}]") & ~bare.isin(*STAND_INS), text)


def read_time(written: Column, zone_minutes: int = 330) -> Column:
    """Microseconds since the epoch of a time in one of several forms; null where unreadable. Times without an offset are local."""
    t = F.trim(written)
    has_zone = t.rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})$") & t.rlike(r"\d:\d")
    iso = F.replace(t, F.lit(" "), F.lit("T"))
    zoned = F.unix_micros(F.try_to_timestamp(iso))
    local = F.unix_micros(F.try_to_timestamp(F.concat(iso, F.lit("Z")))) - zone_minutes * 60_000_000
    return (
        F.when(t.rlike(r"^\d{13}$"), t.cast("long") * 1000)
        .when(t.rlike(r"^\d{10}$"), t.cast("long") * 1_000_000)
        .when(t.rlike(r"^\d{16}$"), t.cast("long"))
        .when(~t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), None)
        .when(has_zone, zoned)
        .otherwise(local)
    )


def connected_components(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """(node, component) of an undirected graph given as (a, b): the component is its smallest node.

    Large-star links every larger neighbour of a node to its smallest neighbour, small-star every smaller
    one; both are one grouped minimum and one join, so that a node of high degree is never gathered. The
    edges are checkpointed each round until a round changes none; two counters come to the driver.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        near = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = near.join(least, "a")
        if large:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        return joined.select("b", "m").union(least.select(F.col("a").alias("b"), "m")).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()

    e = edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    for _ in range(rounds):
        e = cut(star(star(e, True), False))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
    raise RuntimeError("components did not settle")


def _key(text: Column) -> Column:
    """Letters and digits of a message, which quote links compare."""
    return F.nullif(F.trim(F.lower(F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}]+", " "))), F.lit(""))


def _quote(text: Column) -> Column:
    """What the first line of a message quotes or replies to; null where it does neither."""
    return _key(F.nullif(F.regexp_extract(text, r"(?i)^\s*(?:>+|re\s*:|in reply to\s*:)\s*([^\n]+)", 1), F.lit("")))


def quote_links(rows: DataFrame) -> DataFrame:
    """(a, b): rows (id, q, r) one of which quotes a message of the other, through the smallest id of each text."""
    says = rows.select("id", F.explode(F.array(*[F.struct(k.alias("key"), F.lit(quotes).alias("quotes")) for c in ("q", "r") for k, quotes in ((_key(F.col(c)), False), (_quote(F.col(c)), True))])).alias("s")).select("id", "s.*").where("key is not null")
    hubs = says.groupBy("key").agg(F.min("id").alias("hub"), F.max("quotes").alias("quoted")).where("quoted")
    return says.join(hubs, "key").select(F.col("id").alias("a"), F.col("hub").alias("b")).where("a != b")


def rebuild_conversations(df: DataFrame) -> DataFrame:
    """Messages of sound conversations: (conversation, session_id, message_no, speaker, log_id, text).

    A row that comes again is read in the copy with most content. A conversation is sound if each of its
    rows has a readable time and some content and its messages alternate from a user's to an assistant's.
    Rows without a session belong to the component of their reply and quote links, else to none; their
    conversations have a null session_id. Rows with a null id, time or content make theirs unsound. Ties in
    time go by row: those with a question first, then by arrival and id. An empty table gives none.
    """
    fields = ["id", "session_id", "timestamp", "query", "response", "received_at"]
    rows = df.select(*[F.col(f) for f in fields]).withColumns({"_q": present(F.col("query")), "_r": present(F.col("response"))})
    content = F.struct(
        (F.col("_q").isNotNull().cast("int") + F.col("_r").isNotNull().cast("int")).alias("parts"),
        (F.coalesce(F.length("_q"), F.lit(0)) + F.coalesce(F.length("_r"), F.lit(0))).alias("size"),
        F.col("timestamp").isNotNull().alias("timed"), F.col("received_at"), F.col("session_id"), F.col("timestamp"), F.col("_q"), F.col("_r"),
    )
    once = rows.groupBy("id").agg(F.max(content).alias("c")).select(
        "id", F.nullif(F.lower(F.regexp_replace("c.session_id", r"^[\s\x{A0}]+|[\s\x{A0}]+$", "")), F.lit("")).alias("session"),
        read_time(F.col("c.timestamp")).alias("at"), "c.received_at", F.col("c._q").alias("q"), F.col("c._r").alias("r"),
    )
    named = once.where("session is not null").withColumn("conversation", F.concat(F.lit("s:"), "session"))
    loose = cut(once.where("session is null and id is not null"))
    links = quote_links(loose)
    component = connected_components(links)
    unnamed = loose.join(component, loose["id"] == component["node"], "left").select(*loose.columns, F.concat(F.lit("c:"), F.coalesce("component", "id")).alias("conversation"))
    every = named.unionByName(unnamed).withColumn("id", F.coalesce("id", F.lit("")))

    bad = F.col("at").isNull() | (F.col("q").isNull() & F.col("r").isNull()) | (F.col("id") == "")
    spoken = F.array_compact(F.array(F.when(F.col("q").isNotNull(), F.struct(F.lit(0).alias("turn"), F.col("q").alias("text"))), F.when(F.col("r").isNotNull(), F.struct(F.lit(1).alias("turn"), F.col("r").alias("text")))))
    spoken = F.when(bad, F.array(F.struct(F.lit(2).alias("turn"), F.lit(None).cast("string").alias("text")))).otherwise(spoken)
    messages = every.select("conversation", F.col("session").alias("session_id"), F.col("id").alias("log_id"), F.coalesce("at", F.lit(0)).alias("at"), "received_at", F.col("q").isNull().alias("answers"), F.explode(spoken).alias("m")).select("*", F.col("m.turn").alias("turn"), F.col("m.text").alias("text")).drop("m")
    placed = spread_positions(messages, ["conversation"], [F.col("at").asc(), F.col("answers").asc(), F.col("received_at").asc(), F.col("log_id").asc(), F.col("turn").asc()], "message_no")
    wrong = (F.col("turn") != (F.col("message_no") - 1) % 2).cast("int")
    sound = placed.groupBy("conversation").agg(F.max(wrong).alias("wrong"), F.max("message_no").alias("n")).where("wrong = 0 and n % 2 = 0").select("conversation")
    return placed.join(sound, "conversation").select("conversation", "session_id", F.col("message_no").cast("int").alias("message_no"), F.when(F.col("turn") == 0, "user").otherwise("assistant").alias("speaker"), "log_id", "text")
