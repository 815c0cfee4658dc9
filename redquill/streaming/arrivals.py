"""Packages and documents that keep arriving.

Each arriving document is read once: its paragraphs are appended to a table as
they come, with no state. Issues are counted by code in windows of arrival time;
the watermark bounds that state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import markup, validation
from ..sources import packages


def arriving_packages(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """(path, modificationTime, seq, part_name, payload, error): parts of the packages that come into a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return packages.parts_of(files, "path string, modificationTime timestamp")


def main_parts(parts: DataFrame) -> DataFrame:
    return parts.where("part_name = 'word/document.xml' OR error IS NOT NULL").drop("seq", "part_name", "error")


def arriving_paragraphs(parts: DataFrame) -> DataFrame:
    """Paragraphs with both views' texts, as their packages arrive; what does not parse is a row with an error."""
    rows = markup.paragraphs(main_parts(parts), "path string, modificationTime timestamp")
    return rows.select("path", "idx", "para_id", *(markup.view_text(v).alias(v) for v in ("accepted", "rejected")), "error")


def issue_counts(parts: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, code, severity, n): issues by window of arrival; what is later than ``late`` is left out."""
    found = validation.issues(main_parts(parts), "path string, modificationTime timestamp")
    counted = found.withWatermark("modificationTime", late).groupBy(F.window("modificationTime", window).alias("w"), "code", "severity").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "code", "severity", "n")


def keep(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends rows to a Parquet table until what is there has been read; files are committed once, also after a restart."""
    return rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
