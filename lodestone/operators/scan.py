"""Discovery in source lines: URLs, REST paths, HTTP methods and authentication.

Lines come as (dir_ord, file, line, text). Every row carries ``ord``, its
place in reading order, and the first of equal rows is the least ``ord``: a
partial minimum before the shuffle, not a sort of all rows of a key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.functions import values as V


def ordinal(pass_: int | Column, *rest: Column) -> Column:
    names = ("a", "b", "c")
    first = F.lit(pass_) if isinstance(pass_, int) else pass_
    return F.struct("dir_ord", "file", first.alias("pass"), F.col("line").cast("int").alias("line"), *[x.cast("int").alias(n) for x, n in zip(rest, names, strict=False)])


def first_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of least ord for each combination of keys."""
    others = [c for c in rows.columns if c not in keys]
    least = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), "ord").alias("r"))
    return least.select(*[F.col("r")[c].alias(c) if c in others else F.col(c) for c in rows.columns])


def matched(lines: DataFrame, pattern: str, kind: int) -> DataFrame:
    found = F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("pos", "raw")
    return lines.where(F.contains("text", F.lit("://"))).select("*", found).withColumn("kind", F.lit(kind))


def discover_urls(lines: DataFrame) -> DataFrame:
    """(url, file, line, context, category, ord): URLs and WebSocket URLs, each once a file, noise left out."""
    web, socket = matched(lines, V.URL, 0), matched(lines, V.WEBSOCKET_URL, 1)
    rows = web.union(socket).withColumn("url", rules.clean_url(F.col("raw")))
    rows = rows.where((F.col("kind") == 1) | ~rules.is_noise(F.col("url")))
    category = F.when(F.col("kind") == 1, "websocket").otherwise(rules.url_category(F.col("url")))
    rows = rows.select("dir_ord", "url", "file", "line", rules.trimmed_context(F.col("text")).alias("context"), category.alias("category"), ordinal(1, F.col("kind"), F.col("pos")).alias("ord"))
    return first_of(rows, ["dir_ord", "file", "url"]).select("url", "file", "line", "context", "category", "ord")


def with_methods(lines: DataFrame) -> DataFrame:
    """lines with method: that of the line, or of the first line within three that names one, or UNKNOWN.

    A window over the lines of one file; files have a bounded size.
    """
    near = Window.partitionBy("dir_ord", "file").orderBy("line").rowsBetween(-3, 3)
    own = lines.withColumn("line_method", rules.http_method(F.col("text")))
    return own.withColumn("method", F.coalesce("line_method", F.first("line_method", ignorenulls=True).over(near), F.lit("UNKNOWN"))).drop("line_method")


def literal_paths(lines: DataFrame) -> DataFrame:
    """Quoted REST paths: a row for each rule's match, with the line's method.

    Lines without a quote before a slash are dropped ahead of the thirty
    rules, but only after methods are known, which they may give.
    """
    quoted = with_methods(lines).where(F.contains("text", F.lit('"/')) | F.contains("text", F.lit("'/")))
    every = F.array(*[F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in V.REST_PATHS])
    by_rule = quoted.select("*", F.posexplode(every).alias("rule", "found")).where(F.size("found") > 0)
    return by_rule.select("*", F.posexplode("found").alias("pos", "raw")).withColumn("path", rules.unquoted(F.col("raw")))


def discover_endpoints(lines: DataFrame, urls: DataFrame) -> DataFrame:
    """(method, path, full_url, file, line, context, category, ord): paths of a file, each once, quoted ones before those of URLs."""
    literal = literal_paths(lines).select("dir_ord", "file", "path", "method", F.lit(None).cast("string").alias("full_url"), "line", rules.trimmed_context(F.col("text")).alias("context"), rules.endpoint_category(F.col("path")).alias("category"), ordinal(0, F.col("rule"), F.col("pos")).alias("ord"))
    path = rules.url_path(F.col("url"))
    derived = urls.withColumn("path", path).where("path is not null")
    derived = derived.select(F.col("ord.dir_ord").alias("dir_ord"), "file", "path", F.lit("UNKNOWN").alias("method"), F.col("url").alias("full_url"), "line", "context", rules.endpoint_category(F.col("path")).alias("category"), "ord")
    return first_of(literal.union(derived), ["dir_ord", "file", "path"]).select("method", "path", "full_url", "file", "line", "context", "category", "ord")


def discover_auth_rows(lines: DataFrame, *more: str) -> DataFrame:
    """(type, context, file, line, rule, ...): a row for each rule that a line matches; works on streams too."""
    tests = F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(t).alias("type"), F.col("text").rlike(p).alias("hit")) for k, (p, t) in enumerate(V.AUTH_PATTERNS)])
    hits = lines.select("*", F.inline(F.filter(tests, lambda x: x["hit"])))
    return hits.withColumn("context", rules.trimmed_context(F.col("text"))).select("type", "context", "file", "line", "rule", *more)


def discover_auth(lines: DataFrame) -> DataFrame:
    """(type, file, line, context, ord): a row for each rule that a line matches."""
    return discover_auth_rows(lines, "dir_ord").select("type", "file", "line", "context", ordinal(0, F.col("rule")).alias("ord"))


def unique_endpoints(endpoints: DataFrame) -> DataFrame:
    return first_of(endpoints, ["method", "path"])


def unique_auth(auth: DataFrame) -> DataFrame:
    return first_of(auth, ["type", "context"])


@dataclass
class ScanResult:
    """What a scan finds; endpoints and auth are unique, urls once a file."""

    urls: DataFrame
    endpoints: DataFrame
    auth: DataFrame
    categories: DataFrame
    files: DataFrame

    def summary(self) -> dict:
        """Counts of files, URLs, endpoints and auth patterns, and endpoints by category."""
        n = self.files.count()
        counts = {r["category"]: r["n"] for r in self.categories.orderBy(F.desc("n"), "first").collect()}
        return {"totalFiles": n, "filesScanned": n, "urlsFound": self.urls.count(), "endpointsFound": self.endpoints.count(), "authPatternsFound": self.auth.count(), "categories": counts}


def category_counts(endpoints: DataFrame) -> DataFrame:
    return endpoints.groupBy("category").agg(F.count("*").alias("n"), F.min("ord").alias("first"))


def scan_lines(lines: DataFrame, files: DataFrame) -> ScanResult:
    urls = discover_urls(lines)
    endpoints = unique_endpoints(discover_endpoints(lines, urls))
    return ScanResult(urls, endpoints, unique_auth(discover_auth(lines)), category_counts(endpoints), files)
