"""Comparison of two source trees by file name and shared tokens."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.functions import values as V


def base_name(path: Column) -> Column:
    """The last part of a path without the first occurrence of its extension."""
    name = F.element_at(F.split(path, r"[/\\]"), -1)
    extension = F.regexp_extract(name, r"(\.[^.]*)\z", 1)
    at = F.instr(name, extension)
    bare = F.concat(F.substring(name, F.lit(1), at - 1), F.substring(name, at + F.length(extension), F.length(name)))
    return F.when((extension == "") | (F.length(name) == F.length(extension)), name).otherwise(bare)


def token_set(content: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(content, F.lit(r"(?<![A-Za-z0-9_])[A-Za-z_]\w{2,}"), F.lit(0)))


def symbols(content: Column) -> Column:
    return F.array_distinct(F.concat(*[F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in V.SYMBOLS]))


def jaccard_percent(a: Column, b: Column) -> Column:
    """Shared tokens in percent of all: 100 for two empty sets, 0 for one."""
    none = (F.size(a) == 0) & (F.size(b) == 0)
    return F.when(none, 100).when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(rules.rounded(F.lit(100.0) * F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))))


def line_count(content: Column) -> Column:
    return F.size(F.split(content, "\n", -1))


@dataclass
class Comparison:
    """matches has a row for each original with a counterpart; the others are what is left."""

    originals: DataFrame
    reconstructed: DataFrame
    matches: DataFrame
    unmatched_originals: DataFrame
    unmatched_reconstructed: DataFrame

    def overall(self) -> DataFrame:
        """overall_similarity: the rounded mean of the matches, 0 without any."""
        return self.matches.agg(F.coalesce(rules.rounded(F.avg("similarity")), F.lit(0)).alias("overall_similarity"))


def compare_sources(originals: DataFrame, reconstructed: DataFrame) -> Comparison:
    """Each file (file, content) of originals with the first file of its base name in reconstructed.

    The other side is reduced to one file a name before the join, so no name
    makes pairs; contents are tokenised once for each file.
    """
    sets = [token_set(F.col("content")).alias("tokens"), symbols(F.col("content")).alias("symbols"), line_count(F.col("content")).alias("lines")]
    left = originals.select(base_name(F.col("file")).alias("base"), F.col("file").alias("original_path"), *sets)
    right = reconstructed.select(base_name(F.col("file")).alias("base"), F.col("file").alias("reconstructed_path"), *sets)
    chosen = right.groupBy("base").agg(F.min_by(F.struct("reconstructed_path", F.col("tokens").alias("r_tokens"), F.col("symbols").alias("r_symbols"), F.col("lines").alias("reconstructed_lines")), "reconstructed_path").alias("r")).select("base", "r.*")
    paired = left.join(chosen, "base")
    matches = paired.select("original_path", "reconstructed_path", jaccard_percent(F.col("tokens"), F.col("r_tokens")).alias("similarity"), F.col("lines").alias("original_lines"), "reconstructed_lines", F.array_sort(F.array_intersect("symbols", "r_symbols")).alias("shared_symbols"))
    lone = left.join(chosen.select("base"), "base", "left_anti").select("original_path")
    rest = right.select("reconstructed_path").join(paired.select("reconstructed_path").distinct(), "reconstructed_path", "left_anti")
    return Comparison(originals, reconstructed, matches, lone, rest)
