"""Source trees as rows: listing, text and numbered lines."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import values as V
from lodestone.sources import storage

#: Folders of a working directory, in the order of their sources.
SCAN_FOLDERS = ("jadx", "unity", "il2cpp", "extracted")
CLASS_FOLDERS = ("jadx", "extracted", "unity", "il2cpp")


def has_extension(path: Column, extensions: Sequence[str]) -> Column:
    return F.lower(path).rlike(rf"\.({'|'.join(extensions)})\z")


def list_files(spark: SparkSession, folder: str, extensions: Sequence[str] = V.SCANNED_EXTENSIONS, max_bytes: int | None = V.MAX_FILE_BYTES, dir_ord: int = 0) -> DataFrame:
    """(dir_ord, file, length, content) of the files under folder, file relative to it.

    Path, extension and size are tested before contents are read; a column
    that is not used is not read at all. Unreadable files are skipped. Names
    that begin with a dot or an underscore, which Spark's reader passes over,
    are found through the file system and read too.
    """
    folder = qualified(spark, folder)
    folders, lone = hidden(spark, folder)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load([folder, *folders])
    rows = rows.select("path", "length", "content")
    if lone:
        rows = rows.union(read_lone(spark, [x for x in lone if max_bytes is None or x[1] <= max_bytes]))
    rows = rows.where(has_extension(F.col("path"), extensions))
    if max_bytes is not None:
        rows = rows.where(F.col("length") <= max_bytes)
    root = (folder if "://" in folder else "file:" + folder).rstrip("/") + "/"
    relative = F.substring(F.regexp_replace("path", F.lit("^file:/+"), F.lit("file:/")), len(root) + 1, 1 << 30)
    return rows.select(F.lit(dir_ord).alias("dir_ord"), relative.alias("file"), "length", "content")


def hadoop_path(spark: SparkSession, path: str):
    """The Hadoop path of a name, and its file system."""
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The whole name of a file or folder: absolute and without . and .. parts; one on the local file system has no scheme."""
    made, system = hadoop_path(spark, path)
    if system.getScheme() == "file":
        return os.path.abspath(re.sub("^file:/+", "/", path))
    return made.makeQualified(system.getUri(), system.getWorkingDirectory()).toString()


def hidden(spark: SparkSession, folder: str) -> tuple[list[str], list[tuple[str, int]]]:
    """Folders under folder, and files (path, length), whose names Spark's reader passes over.

    Walks folders only as far as file names go; a hidden folder's own hidden
    parts are listed as well.
    """
    made, system = hadoop_path(spark, folder)
    folders, lone, open_ = [], [], [made] if system.exists(made) else []
    while open_:
        for status in system.listStatus(open_.pop()):
            path, name = status.getPath(), status.getPath().getName()
            passed = name.startswith((".", "_"))
            if status.isDirectory():
                open_.append(path)
                if passed:
                    folders.append(path.toString())
            elif passed and not name.endswith((".crc", "_SUCCESS")):
                lone.append((path.toString(), status.getLen()))
    return folders, lone


def read_lone(spark: SparkSession, named: list[tuple[str, int]]) -> DataFrame:
    """(path, length, content) of single files, read by the tasks; those that can't be read are left out."""

    def read(batches):
        for part in batches:
            made = []
            for path, length in zip(part["path"], part["length"], strict=True):
                try:
                    made.append((path, length, storage.read_bytes(path)))
                except OSError:
                    continue
            yield pd.DataFrame(made, columns=["path", "length", "content"])

    return spark.createDataFrame(named, "path string, length long").mapInPandas(read, "path string, length long, content binary")


def existing(spark: SparkSession, workdir: str, names: Sequence[str]) -> list[str]:
    """Those of the folders of workdir that exist, in order, on whatever file system workdir is."""
    found = [(f"{workdir}/{n}", *hadoop_path(spark, f"{workdir}/{n}")) for n in names]
    return [name for name, path, system in found if system.exists(path)]


def source_files(spark: SparkSession, folders: Sequence[str], **options) -> DataFrame | None:
    """The files of several folders, which come in the order given; null for no folder."""
    found = None
    for k, folder in enumerate(folders):
        part = list_files(spark, folder, dir_ord=k, **options)
        found = part if found is None else found.unionByName(part)
    return found


def as_text(files: DataFrame) -> DataFrame:
    """content as text: bytes that aren't UTF-8 become replacement characters, a byte-order mark stays."""
    return files.withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))


def numbered_lines(files: DataFrame) -> DataFrame:
    """(dir_ord, file, line, text) of each line; only \\n ends one, and an empty last line counts."""
    split = F.posexplode(F.split("content", F.lit("\n"), -1)).alias("pos", "text")
    return files.select("dir_ord", "file", split).select("dir_ord", "file", (F.col("pos") + 1).alias("line"), "text")
