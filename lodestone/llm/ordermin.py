"""Document fingerprints by Order MinHash, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import SPACE, bind, table

#: Words in a k-mer, k-mers in a tuple, and the logarithm of the number of tuples.
KMER, TUPLE, BITS = 3, 2, 6
#: Low bits of a k-mer's code that hold its position; the rest is its hash. Texts of over 2**PLACE k-mers have the
#: order of the two k-mers of a tuple by position modulo 2**PLACE.
PLACE = 24
_MASK = (1 << PLACE) - 1
#: Rows that one task puts in order, about, as long as there are no more than MOST_STRETCHES of them.
STRETCH, MOST_STRETCHES = 1024, 16_384


def signature(text: Column, kmer: int = KMER, tuple_size: int = TUPLE, bits: int = BITS) -> Column:
    """The Order MinHash signature of a text: an array of codes, at most 2**bits.

    Each k-mer of words counts with the number of its occurrence in the text,
    so repeats differ. Hashes of numbered k-mers fall into 2**bits equal
    ranges; of each range the tuple_size smallest are taken, put into text
    order and hashed together. A code is that hash behind the number of its
    range; empty ranges have none. Texts of fewer than kmer words make one
    k-mer, blank texts none.
    """
    words = F.array_remove(F.split(text, f"{SPACE}+"), "")
    hash_of = lambda v: F.shiftright(v, PLACE)
    coded = lambda h, i: h.bitwiseAND(F.lit(~_MASK)).bitwiseOR(i.bitwiseAND(F.lit(_MASK)))
    range_of = lambda v: F.shiftright(v, 64 - bits)

    def kmers(w: Column) -> Column:
        many = F.transform(F.slice(w, 1, F.greatest(F.size(w) - (kmer - 1), F.lit(0))), lambda a, i: coded(F.xxhash64(a, *[F.get(w, i + j) for j in range(1, kmer)]), i.cast("long")))
        return F.when(F.size(w) >= kmer, many).when(F.size(w) > 0, F.array(coded(F.xxhash64(w), F.lit(0).cast("long")))).otherwise(F.array().cast("array<bigint>"))

    def numbered(s: Column) -> Column:
        def occurrence(v: Column, i: Column) -> Column:
            """How many equal k-mers come before, by bisection of the sorted codes."""
            same = lambda n: (i - n >= 0) & (hash_of(F.get(s, F.greatest(i - n, F.lit(0)))) == hash_of(v))
            steps = F.array(*[F.lit(1 << b) for b in range(PLACE - 1, -1, -1)])
            return F.aggregate(steps, F.lit(0), lambda n, step: F.when(same(n + step), n + step).otherwise(n))

        fresh = lambda v, i: (i == 0) | (hash_of(F.get(s, F.greatest(i - 1, F.lit(0)))) != hash_of(v))
        return F.transform(s, lambda v, i: F.when(fresh(v, i), v).otherwise(coded(F.xxhash64(hash_of(v), occurrence(v, i)), v)))

    def smallest(g: Column) -> Column:
        return F.filter(g, lambda v, i: (i < tuple_size) | (range_of(F.get(g, F.greatest(i - tuple_size, F.lit(0)))) != range_of(v)))

    def tuples(f: Column) -> Column:
        def code(v: Column, i: Column) -> Column:
            own = F.filter(F.slice(f, i + 1, tuple_size), lambda x: range_of(x) == range_of(v))
            in_text_order = F.sort_array(F.transform(own, lambda x: F.shiftleft(x, 64 - PLACE).bitwiseXOR(F.shiftrightunsigned(x, PLACE))))
            held = F.transform(in_text_order, lambda x: x.bitwiseAND(F.lit((1 << (64 - PLACE)) - 1)))
            return F.shiftrightunsigned(F.xxhash64(held), bits).bitwiseOR(F.shiftleft(range_of(v), 64 - bits))

        leads = F.transform(f, lambda v, i: F.when((i == 0) | (range_of(F.get(f, F.greatest(i - 1, F.lit(0)))) != range_of(v)), code(v, i)))
        return F.array_compact(leads)

    hashed = bind(words, lambda w: F.transform(w, lambda x: F.xxhash64(x)))
    ordered = bind(hashed, lambda w: F.sort_array(kmers(w)))
    return bind(bind(bind(ordered, lambda s: F.sort_array(numbered(s))), smallest), tuples)


def likeness(a: Column, b: Column, bits: int = BITS) -> Column:
    """Shared codes over the ranges that either signature has; two signatures without codes are alike."""
    ranges = lambda s: F.transform(s, lambda v: F.shiftright(v, 64 - bits))
    either = F.size(F.array_union(ranges(a), ranges(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(either, F.lit(1)))


def as_text(sign: Column) -> Column:
    return F.array_join(F.transform(sign, lambda v: F.lower(F.lpad(F.hex(v), 16, "0"))), "")


def in_stretches(rows: DataFrame, length: int = STRETCH, most: int = MOST_STRETCHES) -> DataFrame:
    """rows (id, text) with _b and _s: the stretch of the order by descending id, then text hash, that each lies in.

    Bounds are quantiles of the ids that occur, so ids may be dense or sparse.
    An id that several bounds fall on has a stretch of its own, as rows
    without id have; it is cut by text hash into as many as bounds fall on it.
    There are at most about 4 * most stretches, however many rows.
    """
    n, known = rows.agg(F.count("*"), F.count("id")).first()
    count = min(most, -(-n // length)) or 1
    bounds: list[int] = []
    if count > 1 and known:
        shares = F.array(*[F.lit(k / count) for k in range(1, count)])
        bounds = rows.agg(F.percentile_approx(F.col("id").cast("long"), shares, 8 * count)).first()[0]
    distinct = sorted(set(bounds))
    own = F.col("id").cast("long")
    held, cuts = F.lit(distinct or [0]), F.lit([bounds.count(x) for x in distinct] if len(distinct) < len(bounds) else [1])
    steps = F.lit([1 << k for k in reversed(range(max(1, len(distinct)).bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(distinct)) & (F.get(held, at + step - 1) <= own), at + step).otherwise(at))
    share = F.xxhash64("text").cast("double") / float(1 << 64) + 0.5
    cut = lambda parts: F.least(F.floor(share * parts), parts - 1).cast("int")
    on = (F.col("_k") > 0) & (F.get(held, F.col("_k") - 1) == own)
    without = max(1, -(-(n - known) * count // max(1, n)))
    rows = rows.withColumn("_k", below)
    b = F.when(own.isNull(), F.lit(-1)).otherwise(2 * F.col("_k") - F.when(on, 1).otherwise(0))
    s = F.when(own.isNull(), cut(F.lit(without))).when(on, cut(F.coalesce(F.get(cuts, F.col("_k") - 1), F.lit(1)))).otherwise(0)
    return rows.withColumns({"_b": b.cast("int"), "_s": s.cast("int")}).drop("_k")


def stretch_heads(rows: DataFrame) -> DataFrame:
    """(_from_b, _from_s, _head): for each stretch of rows (id, text, _b, _s) the text of the row after its last one.

    That is the first row of the next stretch, for the last stretch the first
    of all. A stretch's first row is a partial maximum; which stretch follows
    comes from the numbers of the stretches alone, of which few exist.
    """
    firsts = rows.groupBy(F.col("_b").alias("_to_b"), F.col("_s").alias("_to_s")).agg(F.max_by("text", F.struct("id", F.bitwise_not(F.xxhash64("text")))).alias("_head"))
    numbers = rows.select("_b", "_s").distinct().withColumn("_here", F.struct("_b", "_s"))
    every = Window.orderBy(F.col("_b").desc(), "_s")
    follows = F.coalesce(F.lead("_here").over(every), F.first("_here").over(every.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    links = numbers.select(F.col("_b").alias("_from_b"), F.col("_s").alias("_from_s"), follows.alias("_to"))
    return links.select("_from_b", "_from_s", F.col("_to._b").alias("_to_b"), F.col("_to._s").alias("_to_s")).join(firsts, ["_to_b", "_to_s"]).select("_from_b", "_from_s", "_head")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stretch: int = STRETCH) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row of docs.

    The edited text has, in place of the last third of the code points (n div
    3), as many of the next document by descending id, or all of it; the
    first follows the last. Ids without value come last, equal ids by a hash
    of the text. A null text counts as empty. Repeated rows follow each
    other; one row alone follows itself. An empty table gives an empty
    result; other columns of docs are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = in_stretches(rows, stretch)
    order = Window.partitionBy("_b", "_s").orderBy(F.col("id").desc(), F.xxhash64("text"))
    led = rows.withColumn("sign", signature(F.col("text")))
    led = led.withColumns({"_text": F.lead("text").over(order), "_sign": F.lead("sign").over(order)})
    led = led.join(stretch_heads(rows), (F.col("_b") == F.col("_from_b")) & (F.col("_s") == F.col("_from_s")), "left")
    last = F.col("_text").isNull()
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    following = F.when(last, F.col("_head")).otherwise(F.col("_text"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(following, F.lit(1), third))
    next_sign = F.when(last, signature(F.col("_head"))).otherwise(F.col("_sign"))
    whole = led.select("id", n.cast("long").alias("n_chars"), "sign", next_sign.alias("next_sign"), F.explode(F.array(edited)).alias("edited"))
    signed = whole.withColumn("edited_sign", signature(F.col("edited"))).select("id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "sign", "next_sign", F.explode(F.array("edited_sign")).alias("edited_sign"))
    return signed.select("id", "n_chars", "edited_sha256", as_text(F.col("sign")).alias("fingerprint"), as_text(F.col("edited_sign")).alias("edited_fingerprint"), likeness(F.col("sign"), F.col("edited_sign")).alias("near_edited"), likeness(F.col("sign"), F.col("next_sign")).alias("near_next"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
