"""The endpoint catalogue: raw endpoints merged by normal path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.functions import values as V


def map_endpoints(endpoints: DataFrame) -> DataFrame:
    """(path, method, full_url, category, sources, parameters, response_hint) for each normal path.

    The method is the first that is known, the URL the first there is, the
    category the first row's; sources keep reading order. Needs ord.
    """
    rows = endpoints.withColumn("normal", rules.normal_path(F.col("path")))
    known = F.col("method") != "UNKNOWN"
    merged = rows.groupBy("normal").agg(
        F.coalesce(F.min_by("method", F.when(known, F.col("ord"))), F.lit("UNKNOWN")).alias("method"),
        F.min_by("full_url", F.when(F.col("full_url").isNotNull() & (F.col("full_url") != ""), F.col("ord"))).alias("full_url"),
        F.min_by("category", "ord").alias("category"),
        F.array_sort(F.collect_list(F.struct("ord", "file", "line", "context"))).alias("found"),
    )
    sources = F.transform("found", lambda s: F.struct(s["file"].alias("file"), s["line"].alias("line"), s["context"].alias("context")))
    return merged.select(F.col("normal").alias("path"), "method", "full_url", "category", sources.alias("sources"), rules.path_parameters(F.col("normal")).alias("parameters"), F.lit(None).cast("string").alias("response_hint"))


def category_rank(category: Column) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in V.ENDPOINT_ORDER]), category).cast("int") - 1


def catalogue(mapped: DataFrame) -> DataFrame:
    """mapped in the order of categories, then of paths."""
    return mapped.orderBy(category_rank(F.col("category")), F.collate("path", "UNICODE"), "path")
