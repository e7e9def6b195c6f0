"""Facts of application packages from their entries and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import rules

# Parts of entry names that tell the engine.
UNITY, IL2CPP, METADATA = "libunity.so", "libil2cpp.so", "global-metadata.dat"
UNREAL, GODOT = ("libue4.so", "libunrealengine.so"), ("libgodot.so", "libgodot_android.so")
NATIVE_LIB = r"(?i)^lib/([^/]+)/(.+\.so)\z"


def detect_engines(entries: DataFrame) -> DataFrame:
    """(archive, engine, has_global_metadata, has_managed_dlls) from rows (archive, entry)."""
    low = F.lower("entry")
    has = lambda *words: F.coalesce(F.bool_or(rules.any_of(low, words)), F.lit(False))
    seen = entries.groupBy("archive").agg(
        has(UNITY).alias("unity"), has(IL2CPP).alias("il2cpp"), has(METADATA).alias("has_global_metadata"),
        F.coalesce(F.bool_or(low.endswith(".dll") & F.contains(low, F.lit("managed"))), F.lit(False)).alias("has_managed_dlls"),
        has(*UNREAL).alias("unreal"), has(*GODOT).alias("godot"),
    )
    engine = F.when(F.col("unity") & (F.col("il2cpp") | F.col("has_global_metadata")), "unity-il2cpp").when(F.col("unity"), "unity-mono").when(F.col("unreal"), "unreal").when(F.col("godot"), "godot").otherwise("native")
    return seen.select("archive", engine.alias("engine"), "has_global_metadata", "has_managed_dlls")


def native_libraries(entries: DataFrame) -> DataFrame:
    """(archive, name, abi, path) of entries lib/<abi>/<name>.so."""
    part = lambda g: F.regexp_extract("entry", NATIVE_LIB, g)
    return entries.where(F.col("entry").rlike(NATIVE_LIB)).select("archive", *[c for c in entries.columns if c.endswith("_ord")], part(2).alias("name"), part(1).alias("abi"), F.col("entry").alias("path"))


# What a start tag holds behind its name: quoted values may hold any character.
INSIDE = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""


def unescaped(text: Column) -> Column:
    """Text with the five named entities of XML and with character references resolved, & last."""
    hex_ = lambda c: F.decode(F.unhex(F.lpad(c, 8, "0")), "UTF-32")
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    parts = F.split(text, r"&#(?=(?:x[0-9A-Fa-f]{1,6}|[0-9]{1,7});)")
    said = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(hex_(F.when(p.startswith("x"), F.regexp_extract(p, "^x([0-9A-Fa-f]+);", 1)).otherwise(F.conv(F.regexp_extract(p, "^([0-9]+);", 1), 10, 16))), F.regexp_replace(p, F.lit("^[^;]*;"), F.lit("")))))
    return F.replace(F.array_join(said, ""), F.lit("&amp;"), F.lit("&"))


def attribute(tag: Column, *names: str) -> Column:
    """The first of the named attributes of a start tag, entities resolved; null if it has none."""
    found = [F.nullif(F.regexp_extract(tag, rf"""\s{n}\s*=\s*("[^"]*"|'[^']*')""", 1), F.lit("")) for n in names]
    raw = F.coalesce(*found)
    return unescaped(F.substring(raw, F.lit(2), F.length(raw) - 2))


def tags(xml: Column, name: str) -> Column:
    return F.regexp_extract_all(xml, F.lit(rf"<{name}(?=[\s/>]){INSIDE}>"), F.lit(0))


def names_of(xml: Column, element: str) -> Column:
    named = F.transform(tags(xml, element), lambda t: attribute(t, "android:name", "name"))
    return F.filter(named, lambda n: n.isNotNull())


def parse_manifests(manifests: DataFrame, xml_col: str = "xml") -> DataFrame:
    """manifests with the facts of each manifest; prefixed attributes come before bare ones, absent ones get defaults."""
    xml = F.regexp_replace(xml_col, F.lit(r"(?s)<!--.*?-->"), F.lit(""))
    root, sdk = F.get(tags(xml, "manifest"), F.lit(0)), F.get(tags(xml, "uses-sdk"), F.lit(0))
    or_ = lambda c, default: F.coalesce(c, F.lit(default))
    app = F.regexp_extract(xml, r"(?s)<application(?=[\s/>]).*", 0)
    return manifests.withColumns({
        "package_name": or_(attribute(root, "package", "android:package"), "unknown"),
        "version_code": or_(attribute(root, "android:versionCode", "versionCode"), "0"),
        "version_name": or_(attribute(root, "android:versionName", "versionName"), "0.0.0"),
        "min_sdk_version": or_(attribute(sdk, "android:minSdkVersion", "minSdkVersion"), "unknown"),
        "target_sdk_version": or_(attribute(sdk, "android:targetSdkVersion", "targetSdkVersion"), "unknown"),
        "permissions": names_of(xml, "uses-permission"),
        "activities": names_of(app, "activity"),
        "services": names_of(app, "service"),
        "content_providers": names_of(app, "provider"),
        "receivers": names_of(app, "receiver"),
    })
