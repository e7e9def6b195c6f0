"""SimHash near-dedup by a byte-position inverted index with count filtering."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import FOLD, connected_components, cut_lineage, fresh, table

SEED = 42
#: Members of a posting list that meet the same number of others in one comparison.
BLOCK = 1024
#: Byte positions in the key of a posting list, at most.
KEY_BYTES = 4


def simhash(text: str | None, width: int = 4) -> int:
    """The 64-bit fingerprint of a text as a signed integer.

    A bit is 1 if it is set in over half of the XXH64 hashes of the word
    shingles, repeats included. Fewer words than width make one shingle; no
    word (null, empty or blank text) makes 0.
    """
    words = (text or "").encode("utf-8", "replace").translate(FOLD).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    n, ones = len(hashes), np.zeros(64, np.int64)
    packed = np.array(hashes, np.uint64).view(np.uint8).reshape(n, 8)
    for at in range(0, n, 1 << 14):  # a very long text needs no more memory than this
        ones += np.unpackbits(packed[at : at + (1 << 14)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def covering(matches: int, width: int) -> list[tuple[int, ...]]:
    """Sets of width byte positions such that any matches of the 8 positions hold one whole set.

    Found greedily: the set that serves most of what is still unserved comes
    next.
    """
    left = set(combinations(range(8), matches))
    chosen: list[tuple[int, ...]] = []
    while left:
        best = max(combinations(range(8), width), key=lambda s: sum(set(s) <= set(x) for x in left))
        chosen.append(best)
        left = {x for x in left if not set(best) <= set(x)}
    return chosen


def linked_within(members: np.ndarray, sides: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that span the groups of two blocks of a posting list (or of one): tally equal bytes, filter, verify."""
    n = len(members)
    signed = members.astype(np.int64)
    octets = signed.view(np.uint8).reshape(n, 8)
    across = len(np.unique(sides)) > 1
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for i in range(n - 1):
        tally = (octets[i + 1 :] == octets[i]).sum(1)
        near = np.flatnonzero((tally >= 8 - max_bits) & ((sides[i + 1 :] != sides[i]) | (not across))) + i + 1
        if len(near):
            near = near[np.bitwise_count(signed[near].view(np.uint64) ^ signed[i : i + 1].view(np.uint64)) <= max_bits]
        for j in near.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[a] = b
                links.append((int(signed[i]), int(signed[j])))
    return links


def near_links(prints: DataFrame, max_bits: int = 4, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all fingerprints fp of at most max_bits (1 to 7) differing bits.

    Fingerprints that differ in k bits agree in 8 - k of their 8 bytes at
    least. The index keeps posting lists for sets of byte positions chosen so
    that such a pair meets in one list (see covering). Within a list the equal
    bytes of each pair are tallied, pairs under the guaranteed minimum go, and
    the rest are verified; of the links only those that span a group come out.
    A list of more than block members is dealt into blocks, each pair of which
    is compared by one task, so memory is bounded and no pair is missed.
    """
    if not 1 <= max_bits <= 7:
        raise ValueError("max_bits must be from 1 to 7")
    sets = covering(8 - max_bits, min(KEY_BYTES, 8 - max_bits))
    # A set is a number of one octal digit a position, so one expression makes the keys of all sets; an expression a set
    # makes plans and code that the driver has to hold.
    codes = [sum(p << 3 * k for k, p in enumerate(positions)) for positions in sets]
    key = F.col("key")
    for k in range(len(sets[0])):
        byte = F.call_function("shiftrightunsigned", "fp", (F.shiftright("key", 3 * k).bitwiseAND(F.lit(7)) * 8).cast("int")).bitwiseAND(F.lit(255))
        key = key * 256 + byte
    listed = prints.select("fp").distinct().select("fp", F.explode(F.lit(codes).cast("array<long>")).alias("key")).select("fp", key.alias("key"))
    sizes = listed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("long")
    # Spark takes the lists for as small as the fingerprints that they are made of, and without a hint broadcasts them.
    shared = cut_lineage(listed.hint("merge").join(sizes.select("key", blocks.alias("blocks")).hint("merge"), "key"))
    dealt = shared.withColumn("side", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))

    @F.pandas_udf("array<struct<a:bigint,b:bigint>>")
    def compare(lists: pd.Series, sides: pd.Series) -> pd.Series:
        return pd.Series([[{"a": a, "b": b} for a, b in linked_within(np.asarray(x), np.asarray(y), max_bits)] for x, y in zip(lists, sides, strict=True)], dtype="object")

    met = dealt.groupBy("key", F.least("side", "other").alias("s"), F.greatest("side", "other").alias("t")).agg(F.collect_list(F.struct("fp", "side")).alias("m"))
    return met.select(F.explode(compare("m.fp", "m.side")).alias("e")).select("e.a", "e.b").distinct()


#: Nodes of fingerprints without any id lie beyond all ids.
BEYOND = 2 * 10**19


def rooted_rows(docs: DataFrame, id_col: str, text_col: str, width: int, max_bits: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(id, twin, fp) of every row, twin being a hash of its text, and (fp, root, component_id) of every fingerprint.

    A fingerprint is named by its smallest id, so the least name in a
    component is its component_id, and no component is gathered at one key.
    """

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(x, width) for x in texts], dtype="int64")

    text = F.col(text_col).cast("string")
    prints = cut_lineage(docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("twin"), fingerprint(text).alias("fp")))
    wide = lambda c: F.col(c).cast("decimal(21,0)")
    names = cut_lineage(prints.groupBy("fp").agg(F.min("id").alias("first")).select("fp", F.coalesce(wide("first"), wide("fp") + F.lit(str(BEYOND)).cast("decimal(21,0)")).cast("decimal(21,0)").alias("name")))
    links = near_links(names.select("fp"), max_bits, block)
    named = links.join(names.select(F.col("fp").alias("a"), F.col("name").alias("one")), "a").join(names.select(F.col("fp").alias("b"), F.col("name").alias("two")), "b")
    roots = connected_components(named.select(F.col("one").alias("a"), F.col("two").alias("b")))
    rooted = names.join(roots, names["name"] == roots["node"], "left").select("fp", F.coalesce("root", "name").alias("root"))
    return prints, rooted.select("fp", "root", F.when(F.col("root") < F.lit(str(BEYOND // 2)).cast("decimal(21,0)"), F.col("root").cast("long")).alias("component_id"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_bits: int = 4, block: int = BLOCK) -> DataFrame:
    """(id, fp, component_id) for every row of docs.

    component_id is the smallest id reachable over links, itself included; it
    is null only where all ids of a group are null. Rows of one fingerprint
    are one node, so copies never form pairs. Repeated rows stay repeated; an
    empty table gives an empty result; other columns of docs are not read.
    """
    prints, groups = rooted_rows(docs, id_col, text_col, width, max_bits, block)
    return prints.join(groups, "fp").select("id", "fp", "component_id")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every document."""
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def place(c: Column) -> tuple[Column, Column]:
    """An id as plain keys, so that the join and the last step share one shuffle."""
    return F.coalesce(c, F.lit(0)), c.isNull()


def first_of_groups(docs: DataFrame, prints: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of docs for each root of groups (fp, root): that of the smallest id among prints (id, twin, fp)."""
    least = prints.join(groups, "fp").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("absent"), "id", "twin")).alias("least"))
    own, number, absent, kept_number, kept_absent, kept_twin = fresh(docs.columns, "twin", "number", "absent", "kept_number", "kept_absent", "kept_twin")
    a, b = place(F.col("least.id"))
    chosen = least.select(a.alias(kept_number), b.alias(kept_absent), F.col("least.twin").alias(kept_twin))
    a, b = place(F.col(id_col).cast("long"))
    rows = docs.withColumns({number: a, absent: b, own: F.xxhash64(F.col(text_col).cast("string"))})
    same = (F.col(number) == F.col(kept_number)) & (F.col(absent) == F.col(kept_absent)) & (F.col(own) == F.col(kept_twin))
    return rows.join(chosen, same, "left_semi").dropDuplicates([number, absent, own]).drop(number, absent, own)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_bits: int = 4, block: int = BLOCK) -> DataFrame:
    """One row of docs for each group of near copies, with all its columns: that of the smallest id.

    Of different texts with that id the one of the least hash stays, of
    repeated rows one. A group without any id keeps one row too; an empty
    table gives an empty result.
    """
    prints, groups = rooted_rows(docs, id_col, text_col, width, max_bits, block)
    return first_of_groups(docs, prints, groups, id_col, text_col)
