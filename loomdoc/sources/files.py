"""Raw files as rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.operators.ranking import spread_positions

GLOB = "*.{txt,TXT,docx,DOCX}"


def docx_text(content: bytes) -> str:
    """Texts of all elements of a document whose tag ends in t, a blank between; empty where the archive holds none."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            root = ElementTree.fromstring(archive.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    return " ".join(e.text for e in root.iter() if e.tag.endswith("}t") and e.text)


def read_files(spark: SparkSession, folder: str, role: str) -> DataFrame:
    """(source, file_path, role, file_size, processed_date, page_content) of the text files under a folder, without lock files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["page_content"] = [docx_text(c) if p.lower().endswith(".docx") else c.decode("utf-8", "ignore") for p, c in zip(batch["file_path"], batch["content"])]
            yield batch.drop(columns="content")

    raw = spark.read.format("binaryFile").option("pathGlobFilter", GLOB).option("recursiveFileLookup", "true").load(folder)
    rows = raw.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("source"), F.col("path").alias("file_path"), F.lit(role).alias("role"), F.col("length").alias("file_size"),
        F.unix_micros("modificationTime").cast("string").alias("processed_date"), "content",
    ).where(~F.col("source").startswith("~$"))
    return rows.mapInPandas(run, "source string, file_path string, role string, file_size long, processed_date string, page_content string")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A JSON log with the fields of the query log; missing fields are null."""
    return spark.read.schema("id string, session_id string, timestamp string, query string, response string, role string, response_time_seconds double, feedback string").option("multiLine", "true").json(path)


def read_config(spark: SparkSession, path: str, defaults: dict[str, str]) -> DataFrame:
    """One row of known settings; what the file does not say has its default. Unknown keys are dropped."""
    fields = ", ".join(f"`{k}` string" for k in defaults)
    return spark.read.schema(fields).option("multiLine", "true").json(path).select(*[F.coalesce(F.col(k), F.lit(v)).alias(k) for k, v in defaults.items()])


def write_store(chunks: DataFrame, path: str) -> None:
    """Chunks as a table that is cut by collection, so that a filter on it prunes files."""
    chunks.write.mode("overwrite").partitionBy("source_db").parquet(path)


def drop_collections(spark: SparkSession, path: str, names: list[str]) -> None:
    """Takes stores out of a table that ``write_store`` wrote: their folders are deleted, the others stay as they are. Unknown names do nothing."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name in names:
        files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, f"source_db={name}"), True)


def append_log(entries: DataFrame, path: str) -> None:
    """Adds entries to a stored log; the newest come first when it is read (logs.once)."""
    entries.write.mode("append").parquet(path)


def write_config(config: DataFrame, path: str, known: list[str]) -> None:
    """One row of settings, of the known ones only, in place of what was there."""
    config.select(*[F.col(k) for k in known if k in config.columns]).coalesce(1).write.mode("overwrite").json(path)


def transcript(messages: DataFrame, session: str, order: list[Column], speaker: str, text: str) -> DataFrame:
    """(session, line_no, line): each conversation as lines of speaker and text in order; ``order`` ends in a unique key. A conversation may be of any length."""
    return spread_positions(messages, [session], order, "line_no").select(session, "line_no", F.concat_ws(": ", speaker, text).alias("line"))


def latin1(c):
    """Typographic signs written in Latin-1."""
    for sign, plain in zip("‘’“”–—…•₹", ("'", "'", '"', '"', "-", "-", "...", "-", "Rs.")):
        c = F.replace(c, F.lit(sign), F.lit(plain))
    return c
