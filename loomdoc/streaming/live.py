"""The same measures over streams. Each query runs over what is there and ends (availableNow)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.session import checkpoint_dir


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


def _run(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """The stream's last output as a table in the shared folder."""
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        """A batch that is tried again overwrites what it wrote; in complete mode each holds the whole result."""
        batch.write.mode("overwrite").parquet(f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={number}")

    running = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).option("basePath", f"{folder}/out").parquet(f"{folder}/out")


def changed(spark: SparkSession, sf_dir: str, name: str, key: str, order: list[str]) -> DataFrame:
    """A table kept from a stream of its changed rows: every batch is written under its number, and the last row of each key is read."""
    path = f"{sf_dir}/{name}.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").parquet(f"{path}*")
    written = _run(spark, rows, "append")
    rest = [c for c in written.columns if c != key]
    newest = F.struct(*[F.coalesce(c, F.lit("")) if c != order[0] else F.col(c) for c in order])
    return written.groupBy(key).agg(F.max_by(F.struct(*rest), newest).alias("r")).select(key, "r.*")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = event_stream(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return _run(spark, live, "complete")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions per user from a stream of events, closed and still open: a touch later than an hour after the last opens a new one.

    Sorted rows are merged one after another, with no list of a user's events. Complete mode gives the
    sessions that are open when the input ends as well as the closed ones, and drops no late event;
    its state holds every session.
    """
    events = event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).where("user_id is not null and ts is not null")
    micros = F.unix_micros("ts")
    live = events.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.min(micros).alias("started"), F.max(micros).alias("ended"), F.count("*").alias("events"))
    return _run(spark, live.select("user_id", "started", "ended", "events"), "complete")
