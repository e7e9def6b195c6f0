"""Discovery over a stream of source files: new files are scanned as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import values as V
from lodestone.operators import scan
from lodestone.sources import files

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch_files(spark: SparkSession, folder: str, extensions=V.SCANNED_EXTENSIONS, max_bytes: int = V.MAX_FILE_BYTES) -> DataFrame:
    rows = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").load(folder)
    rows = rows.where(files.has_extension(F.col("path"), extensions) & (F.col("length") <= max_bytes))
    return rows.select(F.lit(0).alias("dir_ord"), F.col("path").alias("file"), "modificationTime", "content")


def watch_auth(spark: SparkSession, folder: str, delay: str = "1 hour") -> DataFrame:
    """(type, context, file, line, modificationTime): auth patterns, each type and context once within the delay."""
    rows = files.as_text(watch_files(spark, folder)).select("*", F.posexplode(F.split("content", F.lit("\n"), -1)).alias("pos", "text"))
    hits = scan.discover_auth_rows(rows.withColumn("line", F.col("pos") + 1), "modificationTime")
    return hits.withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["type", "context"])
