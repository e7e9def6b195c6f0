"""Packages as rows: archive entries, nested packages and compiled manifests."""

from __future__ import annotations

import hashlib
import io
import posixpath
import struct
import zipfile
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.operators import package
from lodestone.sources import storage

ENTRY = "archive string, input_type string, sha256 string, entry_ord int, entry string, size long, content binary"
#: Entries of which the content is kept; of others only the name counts.
KEPT = ("AndroidManifest.xml",)
#: What reading a damaged, encrypted or unknown archive raises.
UNREADABLE = (zipfile.BadZipFile, zlib.error, KeyError, ValueError, AttributeError, RuntimeError, NotImplementedError, EOFError, OSError)
# Chunk and attribute types of compiled XML.
XML, POOL, START, END = 0x0003, 0x0001, 0x0102, 0x0103
REFERENCE, STRING, INTEGER, BOOLEAN = 0x01, 0x03, 0x10, 0x12


def inner_package(names: list[str]) -> str | None:
    """base.apk of a bundle in any case, or else its first .apk."""
    packages = [n for n in names if n.lower().endswith(".apk")]
    return next((n for n in packages if n.lower().rpartition("/")[2] == "base.apk"), packages[0] if packages else None)


def read_entry(bundle: zipfile.ZipFile, info: zipfile.ZipInfo) -> bytes | None:
    """An entry's content; null where it is encrypted, damaged or packed in an unknown way.

    Packages often mark entries as encrypted that are not, so the mark is
    taken away for a second try.
    """
    try:
        return bundle.read(info)
    except UNREADABLE:
        if not info.flag_bits & 1:
            return None
    info.flag_bits &= ~1
    try:
        return bundle.read(info)
    except UNREADABLE:
        return None


def expand(archives: DataFrame, nested: bool = True, every: bool = False) -> DataFrame:
    """archives (path, content) as a row for each entry, in order; bundles are replaced by the package inside them.

    sha256 is that of the package the entries are of. Other splits of a bundle
    are not read. What isn't an archive, or a bundle without a package, has no
    entries. Contents are kept of manifests, or of every entry.
    """

    def read(batches):
        for part in batches:
            made = []
            for path, kind, sha, content in zip(part["path"], part["input_type"], part["sha256"], part["content"], strict=True):
                try:
                    bundle = zipfile.ZipFile(io.BytesIO(bytes(content)))
                    if nested and kind == "xapk":
                        own = bundle.read(inner_package(bundle.namelist()))
                        bundle, sha = zipfile.ZipFile(io.BytesIO(own)), hashlib.sha256(own).hexdigest()
                except UNREADABLE:
                    continue
                for k, info in enumerate(bundle.infolist()):
                    kept = info.filename in KEPT or (every and not info.is_dir())
                    made.append((path, kind, sha, k, info.filename, info.file_size, read_entry(bundle, info) if kept else None))
            yield pd.DataFrame(made, columns=["archive", "input_type", "sha256", "entry_ord", "entry", "size", "content"])

    rows = archives.select("path", rules.input_type(F.col("path")).alias("input_type"), F.sha2("content", 256).alias("sha256"), "content")
    return rows.mapInPandas(read, ENTRY)


def decode_xml(data: bytes | None) -> str | None:
    """The text of a compiled XML document after its public layout; null for anything else."""
    try:
        if data is None or len(data) < 8 or struct.unpack_from("<H", data)[0] != XML:
            return None
        at, pool, out = struct.unpack_from("<H", data, 2)[0], [], ['<?xml version="1.0" encoding="utf-8"?>']
        name = lambda i: pool[i] if 0 <= i < len(pool) else f"@0x{i & 0xFFFFFFFF:x}"
        while at + 8 <= len(data):
            kind, header, size = struct.unpack_from("<HHI", data, at)
            if size < 8:
                break
            if kind == POOL:
                pool = read_pool(data, at, header)
            elif kind == START:
                body = at + header
                _, element, first, width, count = struct.unpack_from("<iiHHH", data, body)
                attributes = []
                for k in range(count):
                    space, key, raw, _, _, type_, value = struct.unpack_from("<iiiHBBI", data, body + first + k * width)
                    prefix = "android:" if space >= 0 and "schemas.android.com" in name(space) else ""
                    if type_ == STRING or raw >= 0:
                        said = name(raw if raw >= 0 else value)
                    elif type_ == INTEGER:
                        said = str(value - (1 << 32) if value >> 31 else value)
                    elif type_ == BOOLEAN:
                        said = "true" if value else "false"
                    elif type_ == REFERENCE:
                        said = f"@0x{value:x}"
                    else:
                        said = str(value)
                    attributes.append(f' {prefix}{name(key)}="{escape_xml(said)}"')
                out.append(f"<{name(element)}{''.join(attributes)}>")
            elif kind == END:
                out.append(f"</{name(struct.unpack_from('<ii', data, at + header)[1])}>")
            at += size
        return "\n".join(out)
    except (struct.error, IndexError, UnicodeDecodeError):
        return None


def read_pool(data: bytes, at: int, header: int) -> list[str]:
    count, _, flags, start = struct.unpack_from("<IIII", data, at + 8)
    out = []
    for k in range(count):
        p = at + start + struct.unpack_from("<I", data, at + header + 4 * k)[0]
        if flags & 0x100:
            p += 2 if data[p] & 0x80 else 1
            n = data[p]
            if n & 0x80:
                n, p = (n & 0x7F) << 8 | data[p + 1], p + 1
            out.append(data[p + 1 : p + 1 + n].decode("utf-8", "replace"))
        else:
            n = struct.unpack_from("<H", data, p)[0]
            if n & 0x8000:
                n, p = (n & 0x7FFF) << 16 | struct.unpack_from("<H", data, p + 2)[0], p + 2
            out.append(data[p + 2 : p + 2 + 2 * n].decode("utf-16-le", "replace"))
    return out


def escape_xml(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def manifest_text(content: Column) -> Column:
    """A manifest's XML: decoded where it is compiled, else taken as text."""

    @F.pandas_udf("string")
    def decode(blobs: pd.Series) -> pd.Series:
        return pd.Series([decode_xml(None if b is None else bytes(b)) for b in blobs], dtype="object")

    return F.coalesce(decode(content), F.make_valid_utf8(content.cast("string")))


def ingest(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """manifests, meta, native_libs and entries of the packages under path (a file, folder or pattern).

    meta has a row for each archive that holds a package: input type, hash of
    the package, engine and flags; manifests one for each archive that has a
    manifest. Archives are unpacked once; release entries when done.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    entries = expand(files).persist()
    engines = package.detect_engines(entries)
    outer = entries.select("archive", "input_type", "sha256").distinct()
    first = Window.partitionBy("archive").orderBy("entry_ord")
    manifests = entries.where("content is not null").withColumn("nth", F.row_number().over(first)).where("nth = 1")
    manifests = package.parse_manifests(manifests.select("archive", manifest_text(F.col("content")).alias("xml")))
    return {"entries": entries, "meta": outer.join(engines, "archive"), "manifests": manifests, "native_libs": package.native_libraries(entries)}


def extract(spark: SparkSession, path: str, folder: str) -> int:
    """Writes the entries of a package under folder, by the task that unpacks it; returns how many.

    folder has to be on a file system that all machines share. Entries whose
    names lead out of folder are not written.
    """

    def write(batches):
        for part in batches:
            done = 0
            for name, content in zip(part["entry"], part["content"], strict=True):
                at = posixpath.normpath(name.replace("\\", "/"))
                if content is not None and not at.startswith(("/", "..")) and at != ".":
                    storage.write_bytes(f"{folder}/{at}", bytes(content))
                    done += 1
            yield pd.DataFrame({"n": [done]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return expand(files, every=True).select("entry", "content").mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0
