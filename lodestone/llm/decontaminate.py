"""Benchmark decontamination by greedy string tiling over Karp-Rabin seeds."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut_lineage, fresh, table, written

#: Shortest tile in words, and the covered share of an item's words from which a document counts as contaminated.
MIN_MATCH, COVERAGE = 5, 0.5
#: Logarithm of the bits in the map of seeds that tasks get, whatever the benchmark's size.
MAP_BITS = 26
#: Bytes of documents' candidate items up to which they are broadcast; beyond, they are joined by a shuffle.
SMALL = 32_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    """Lower-cased words without punctuation."""
    return _WORD.findall(text.lower()) if text else []


class WordHashes(dict):
    """The XXH64 of each word asked for."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def karp_rabin(ids: np.ndarray, width: int) -> np.ndarray:
    """The polynomial hash, modulo 2**64, of each window of width ids."""
    n = len(ids) - width + 1
    out = np.zeros(max(0, n), np.uint64)
    for i in range(width if n > 0 else 0):
        out = out * _BASE + ids[i : i + n].astype(np.uint64)
    return out


class Rolling:
    """Hashes of windows of any width over one sequence of numbers, and which of its places are unmarked."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]), dtype=np.uint64)
        self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE, np.uint64)]), dtype=np.uint64)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(ids.astype(np.uint64) * power[:n], dtype=np.uint64)])
        self.marked = np.zeros(n, bool)

    def at(self, places: np.ndarray, width: int) -> np.ndarray:
        return (self.sums[places + width] - self.sums[places]) * self.back[places]

    def free(self) -> np.ndarray:
        """For each place the unmarked places from there on."""
        n = len(self.marked)
        stops = np.append(np.flatnonzero(self.marked), n)
        return stops[np.searchsorted(stops, np.arange(n))] - np.arange(n)


def tile(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (item place, document place, length) of two sequences of numbers.

    The longest match of unmarked places is marked again and again, the first
    in the item and then in the document among equals, until none of at least
    least places is left. The greatest length that still has a match is found
    by bisection over Karp-Rabin hashes of windows; no pairs of places are
    held, so repetitive sequences need memory for their own lengths only.
    """
    if min(len(item), len(doc)) < least:
        return []
    mine, other = Rolling(item), Rolling(doc)
    starts = np.arange(len(item) - least + 1)
    places = np.arange(len(doc) - least + 1)
    places = places[np.isin(other.at(places, least), mine.at(starts, least))]
    tiles, high = [], min(len(item), len(doc))
    while high >= least and len(places):
        free_i, free_d = mine.free(), other.free()
        starts, places = starts[free_i[starts] >= least], places[free_d[places] >= least]

        def common(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Places of windows that occur on both sides, with their hashes."""
            i, d = starts[free_i[starts] >= width], places[free_d[places] >= width]  # noqa: B023
            a, b = mine.at(i, width), other.at(d, width)
            kept_a, kept_b = np.isin(a, b), np.isin(b, a)
            return i[kept_a], a[kept_a], d[kept_b], b[kept_b]

        low, up = least - 1, high
        while low < up:
            middle = (low + up + 1) // 2
            if len(common(middle)[0]):
                low = middle
            else:
                up = middle - 1
        if low < least:
            break
        i, a, d, b = common(low)
        order = np.argsort(b, kind="stable")
        d, b = d[order], b[order]
        first, last = np.searchsorted(b, a).tolist(), np.searchsorted(b, a, "right").tolist()
        passed: dict[int, int] = {}
        for k, place in enumerate(i.tolist()):
            if mine.marked[place] or mine.marked[place + low - 1]:
                continue
            at = passed.get(first[k], first[k])
            while at < last[k] and (other.marked[d[at]] or other.marked[d[at] + low - 1]):
                at += 1
            passed[first[k]] = at
            while at < last[k]:
                to = int(d[at])
                if not (other.marked[to] or other.marked[to + low - 1]) and np.array_equal(item[place : place + low], doc[to : to + low]):
                    mine.marked[place : place + low] = True
                    other.marked[to : to + low] = True
                    tiles.append((place, to, low))
                    break
                at += 1
        high = low - 1
    return tiles


def leaks_of(text: str | None, items: list, least: int, coverage: float) -> list[dict]:
    """Those of items (item, text) that a text covers enough of."""
    said, numbers = tokens(text), {}
    doc = np.array([numbers.setdefault(w, len(numbers)) for w in said], np.int64)
    found = []
    for item in items:
        own = np.array([numbers.setdefault(w, len(numbers)) for w in tokens(item["text"])], np.int64)
        tiles = tile(own, doc, least)
        covered = sum(t[2] for t in tiles)
        if tiles and covered >= coverage * len(own):
            found.append({"item": item["item"], "item_tokens": len(own), "covered_tokens": covered, "tiles": len(tiles)})
    return found


def seed_rows(items: DataFrame, least: int) -> DataFrame:
    """(item, h, place, n): every window of least words of every item (item, text), n its number of words."""

    def seeds(batches):
        known = WordHashes()
        for part in batches:
            for item, text in zip(part["item"], part["text"], strict=True):
                said = tokens(text)
                h = karp_rabin(np.fromiter(map(known.__getitem__, said), np.uint64, len(said)), least).view(np.int64)
                yield pd.DataFrame({"item": item, "h": h, "place": np.arange(len(h)), "n": len(said)})

    return items.select("item", "text").mapInPandas(seeds, "item long, h long, place long, n long")


def seed_map(seeds: DataFrame, bits: int) -> np.ndarray:
    """A map of 2**bits bits in which the highest bits of each seed's hash are set."""
    at = F.shiftrightunsigned("h", 64 - bits)
    words = seeds.groupBy(F.shiftright(at, 6).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int)))").alias("set")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["word"].to_numpy()] = words["set"].to_numpy()
    return out.view(np.uint64)


def candidates(rows: DataFrame, seeds: DataFrame, least: int, coverage: float, bits: int) -> DataFrame:
    """(id, twin, items) for the rows (id, twin, text) that share enough seeds with an item to cover enough of it.

    Texts are read once, whatever the benchmark's size: each gives its
    distinct seeds that the map of bounded size does not rule out, and these
    meet the benchmark's seeds in a join.
    """
    kind = dict(rows.dtypes)["id"]
    held = seed_map(seeds, bits)
    shift, low = np.uint64(64 - bits), np.uint64(63)

    def emit(batches):
        known = WordHashes()
        for part in batches:
            ids, twins, lists = [], [], []
            for i, twin, text in zip(part["id"], part["twin"], part["text"], strict=True):
                said = tokens(text)
                if len(said) < least:
                    continue
                h = karp_rabin(np.fromiter(map(known.__getitem__, said), np.uint64, len(said)), least)
                at = h >> shift
                h = h[(held[at >> np.uint64(6)] >> (at & low)) & np.uint64(1) == 1]
                if len(h):
                    ids.append(i)
                    twins.append(twin)
                    lists.append(np.unique(h.view(np.int64)))
            made = pd.DataFrame({"twin": pd.Series(twins, dtype="int64"), "hs": pd.Series(lists, dtype="object")})
            made.insert(0, "id", pd.Series(ids, dtype=part["id"].dtype))
            yield made

    met = rows.mapInPandas(emit, f"id {kind}, twin long, hs array<long>").select("id", "twin", F.explode("hs").alias("h")).distinct().join(seeds, "h")
    places = met.groupBy("id", "twin", "item", "n").agg(F.sort_array(F.collect_set("place")).alias("p"))
    most = F.aggregate(F.transform("p", lambda x, k: F.when(k == 0, least).otherwise(F.least(F.lit(least), x - F.get("p", k - 1)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return places.where(most >= coverage * F.col("n")).groupBy("id", "twin").agg(F.collect_set("item").alias("items"))


def leaks(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, least: int, coverage: float, bits: int) -> DataFrame:
    """(id, twin, hits, item rows) for each row of docs that covers enough of an item; twin is a hash of its text."""
    numbered = written(items.where("text is not null").select(F.monotonically_increasing_id().alias("item"), "item_id", F.col("text").cast("string").alias("text")))
    text = F.col(text_col).cast("string")
    rows = docs.where(text.isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("twin"), text.alias("text"))
    found = candidates(rows, written(seed_rows(numbered, least)), least, coverage, bits)
    asked = found.select(F.col("id").alias("of"), F.col("twin").alias("of_twin"), F.explode("items").alias("item")).join(numbered, "item")
    asked = cut_lineage(asked.groupBy("of", "of_twin").agg(F.collect_list(F.struct("item", "text")).alias("items")))
    size = asked.agg(F.sum(F.expr("32 + aggregate(items, 0L, (a, x) -> a + 16 + octet_length(x.text))"))).first()[0] or 0

    @F.pandas_udf("array<struct<item:long,item_tokens:long,covered_tokens:long,tiles:long>>")
    def search(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([leaks_of(t, x, least, coverage) for t, x in zip(texts, lists, strict=True)], dtype="object")

    asked = F.broadcast(asked) if size <= SMALL else asked
    met = rows.join(asked, F.col("id").eqNullSafe(F.col("of")) & (F.col("twin") == F.col("of_twin")))
    hits = met.select("id", "twin", F.explode(search("text", "items")).alias("hit")).select("id", "twin", "hit.*")
    return hits.join(numbered.select("item", "item_id"), "item")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, map_bits: int = MAP_BITS) -> DataFrame:
    """(id, item_id, item_tokens, covered_tokens, tiles): each document and item it covers enough of.

    Tiles don't overlap, in the item or in the document, so reordered parts
    of an item count together. Items of fewer than min_match words have no
    tile and match nothing, nor do null and empty texts on either side.
    Repeated documents give repeated rows, repeated items rows for each; ids
    may be null or shared by different texts. Empty tables give an empty
    result; other columns of docs and items are not read.
    """
    return leaks(docs, items, id_col, text_col, min_match, coverage, map_bits).select("id", "item_id", "item_tokens", "covered_tokens", "tiles")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, map_bits: int = MAP_BITS) -> DataFrame:
    """The rows of docs that cover enough of no item, with all their columns.

    Rows are told apart by id and text, so a clean text stays where another
    one of the same id goes, and repeated rows go or stay together. Null and
    empty texts stay.
    """
    own, gone, gone_twin = fresh(docs.columns, "twin", "gone", "gone_twin")
    bad = cut_lineage(leaks(docs, items, id_col, text_col, min_match, coverage, map_bits).select(F.col("id").alias(gone), F.col("twin").alias(gone_twin)).distinct())
    bad = F.broadcast(bad) if bad.count() * 64 <= SMALL else bad
    rows = docs.withColumn(own, F.xxhash64(F.col(text_col).cast("string")))
    return rows.join(bad, F.col(id_col).eqNullSafe(F.col(gone)) & (F.col(own) == F.col(gone_twin)), "left_anti").drop(own)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of documents with every item of benchmark that it leaks."""
    hits = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    share = F.col("covered_tokens") / F.col("item_tokens")
    return hits.withColumnRenamed("id", "doc_id").withColumn("coverage", share)
