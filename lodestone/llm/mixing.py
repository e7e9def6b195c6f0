"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import SPACE, cut_lineage, fresh, table

#: Tokens in a block at most, blocks that a source is cut into at least (if it has the tokens).
BLOCK_TOKENS = 2048
LEAST_BLOCKS = 1024
#: 2**64 divided by the golden ratio, for points that need no floating-point product.
GOLDEN = 11400714819323198485
#: Cells of the unit interval over which slots meet source intervals.
CELLS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(SPACE.replace("[", "[^") + "+")), F.lit(0)).cast("long")


def mixed(id_: Column) -> Column:
    """Where a hash of the id puts a row in the shuffle: 60 bits of its MD5, which SQL engines agree on."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("shuffle "), F.coalesce(id_.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """Orders sources by code point, null last."""
    return F.struct(source.isNull().alias("absent"), F.coalesce(source.cast("string"), F.lit("")).alias("name"))


def running_before(rows: DataFrame, group: str, bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """rows with out: the sum of value over the rows of its group that come before it, by bucket and order.

    Buckets are summed first, so that a group of any size is spread over its
    buckets and only the sums of a group meet in one task.
    """
    sums = rows.groupBy(group, bucket).agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(group, bucket, F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(offsets, [group, bucket]).withColumn(out, F.col("_offset") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_offset")


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """sizes (source_key, source_size) with rank, weight and target of each source.

    Sources weigh weights in turn, in the order of source_key. They share
    share times all sizes; a target stops at most times its source's size and
    the excess is reshared by weight. In the order of most * size / weight the
    stopped sources come first, so one pass of running sums finds the level.
    """
    n = len(weights)
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy("source_key")) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("rank") % n + 1)
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    ahead = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(ahead), F.lit(0.0))
    leveled = ranked.withColumn("level", left / F.sum("weight").over(onward)).withColumn("stopped", F.col("cap") <= F.col("level") * F.col("weight"))
    level = F.min(F.when(~F.col("stopped"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)
    return leveled.withColumn("target", F.when(F.col("stopped"), F.col("cap")).otherwise(level["level"] * F.col("weight"))).select("source_key", "source_size", "rank", "weight", "target")


def place(docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, buckets: int = 1024) -> DataFrame:
    """Every row's place in its source's shuffled token stream.

    (id, source_key, size, start, source_size, target, blocks); source_key
    orders sources by code point, null last. The shuffle is by a hash of the
    id, so reruns agree. Repeated rows take places of their own.
    """
    rows = docs.select(F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("source_key"), size.alias("size"))
    rows = cut_lineage(rows.withColumn("mixed", mixed(F.col("id"))).withColumn("bucket", F.pmod("mixed", F.lit(buckets))))
    sizes = rows.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, list(weights), share, most)
    least = F.least(F.col("source_size"), F.lit(LEAST_BLOCKS))
    targets = targets.withColumn("blocks", F.greatest(F.ceil(F.col("source_size") / BLOCK_TOKENS), least).cast("long"))
    started = running_before(rows, "source_key", "bucket", ["mixed", "id", "size"], "size", "start")
    return cut_lineage(started.join(targets, "source_key").select("id", "source_key", "size", "start", "source_size", "rank", "target", "blocks"))


def schedule(placed: DataFrame, most: float = 2.0) -> DataFrame:
    """(slot, source_key, block): the blocks of the mix in its order.

    Slot k has the point frac(k * golden ratio); the point falls into the
    interval of one source, as wide as the slots that source needs. The slots
    of a source take its blocks in turn, and no more than most times each.
    """
    sources = placed.groupBy("source_key").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("blocks").alias("blocks"), F.first("rank").alias("rank"))
    sources = sources.where("source_size > 0").withColumn("need", F.col("target") / F.col("source_size") * F.col("blocks"))
    upto = Window.orderBy("rank")
    everything = upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = cut_lineage(sources.withColumn("total", F.sum("need").over(everything)).withColumn("high", F.sum("need").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.col("total")).withColumn("low", F.coalesce(F.lag("high").over(upto), F.lit(0.0))))
    total = sources.agg(F.max("total")).first()[0] or 0.0
    point = (F.col("slot").cast("decimal(18,0)") * F.lit(str(GOLDEN)).cast("decimal(20,0)") % F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("double") / F.lit(float(1 << 64))
    slots = placed.sparkSession.range(1, round(total) + 1).withColumnRenamed("id", "slot").withColumn("point", point).withColumn("cell", F.least(F.floor(F.col("point") * CELLS), F.lit(CELLS - 1)))
    spans = sources.withColumn("cell", F.explode(F.sequence(F.least(F.floor(F.col("low") * CELLS), F.lit(CELLS - 1)), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))))
    last = F.col("high") >= F.lit(1.0) - F.lit(1e-12)
    dealt = slots.join(spans, "cell").where((F.col("point") >= F.col("low")) & ((F.col("point") < F.col("high")) | last))
    dealt = dealt.select("slot", "source_key", "blocks", F.expr("slot div 4096").alias("run"), F.lit(1).cast("long").alias("one"))
    ranked = running_before(cut_lineage(dealt), "source_key", "run", ["slot"], "one", "nth")
    return ranked.where(F.col("nth") < F.col("blocks") * F.lit(float(most))).select("slot", "source_key", (F.col("nth") % F.col("blocks")).alias("block"))


def pieces(placed: DataFrame) -> DataFrame:
    """(source_key, block, id, start, size, from, length): what of each row lies in each block of its source."""
    wide = lambda c: c.cast("decimal(18,0)")

    def whole(a: Column, b: Column) -> Column:
        return ((a - a % wide(b)) / wide(b)).cast("long")

    holding = lambda t: whole(wide(t + 1) * wide(F.col("blocks")) - 1, F.col("source_size"))
    edge = lambda j: whole(wide(j) * wide(F.col("source_size")), F.col("blocks"))
    cut = placed.where("size > 0").withColumn("block", F.explode(F.sequence(holding(F.col("start")), holding(F.col("start") + F.col("size") - 1))))
    low, high = F.greatest(edge(F.col("block")), F.col("start")), F.least(edge(F.col("block") + 1), F.col("start") + F.col("size"))
    cut = cut.withColumn("from", low - F.col("start")).withColumn("length", high - low)
    return cut.where("length > 0").select("source_key", "block", "id", "start", "size", "from", "length")


def mix(placed: DataFrame, most: float = 2.0) -> DataFrame:
    """The mix: (slot, id, start, size, source_key, from, length), a row for each piece of a document in each slot."""
    return schedule(placed, most).join(pieces(placed), ["source_key", "block"])


def taken_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """(id, size, source_size, target, taken) for every row of docs.

    size counts the words of the text (null: 0); taken counts the words that
    the mix takes, repeats counted. A row without words is never taken. An
    empty table, or one without any word, gives targets of 0 and no slot.
    """
    placed = place(docs, word_count(F.col(text_col)), id_col, source_col, **options)
    return taken_of(placed, options.get("most", 2.0)).select("id", "size", "source_size", "target", "taken")


def taken_of(placed: DataFrame, most: float = 2.0) -> DataFrame:
    """placed with taken, the words of each row that the mix takes."""
    keys = ["source_key", "start", "id", "size"]
    taken = mix(placed, most).groupBy(*keys).agg(F.sum("length").alias("taken"))
    taken = taken.select(*[F.col(k).alias(f"taken_{k}") for k in keys], "taken")
    same = [F.col(k).eqNullSafe(F.col(f"taken_{k}")) for k in keys]
    return placed.join(taken, same, "left").select(*placed.columns, F.coalesce("taken", F.lit(0)).cast("long").alias("taken_words")).withColumnRenamed("taken_words", "taken")


def mix_documents(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", **options) -> DataFrame:
    """docs with size, source_size, target and taken.

    Rows are told apart by id, source and size; of repeated ones each gets
    the place of one of them. Columns of docs with these names are replaced.
    """
    columns = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    count = word_count(F.col(text_col))
    done = taken_of(place(docs, count, id_col, source_col, **options), options.get("most", 2.0))
    names = fresh([*docs.columns, "size", "source_size", "target", "taken"], "key", "nth", "of_id", "of_key", "of_size", "of_nth")
    key, nth, of_id, of_key, of_size, of_nth = names
    turn = Window.partitionBy("id", "source_key", "size")
    done = done.withColumn(of_nth, F.row_number().over(turn.orderBy("start", "taken"))).select(F.col("id").alias(of_id), F.col("source_key").alias(of_key), F.col("size").alias(of_size), of_nth, "source_size", "target", "taken")
    rows = docs.select(*columns, count.alias("size"), source_key(F.col(source_col)).alias(key))
    own = Window.partitionBy(id_col, key, "size").orderBy(F.xxhash64(text_col))
    rows = rows.withColumn(nth, F.row_number().over(own))
    same = F.col(id_col).eqNullSafe(F.col(of_id)) & (F.col(key) == F.col(of_key)) & (F.col("size") == F.col(of_size)) & (F.col(nth) == F.col(of_nth))
    return rows.join(done, same).select(*columns, "size", "source_size", "target", "taken")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    return taken_words(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_sql(weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, buckets: int = 1024) -> str:
    """The same as DuckDB SQL, for ids that occur once: slots are dealt by the place of their point among the sources' intervals."""
    listed = ", ".join(str(float(w)) for w in weights)
    blank = SPACE.replace("[", "[^") + "+"
    return rf"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{blank}')), 0)::BIGINT AS size,
    ('0x' || substr(md5('shuffle ' || doc_id), 1, 15))::BIGINT AS mixed FROM documents
), placed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY mixed % {buckets}, mixed, doc_id) - size AS start FROM docs
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM docs GROUP BY source
), weighed AS (
  SELECT *, {most}::DOUBLE * source_size AS cap, ([{listed}]::DOUBLE[])[(rank % {len(weights)} + 1)::INT] AS weight,
    greatest(ceil(source_size / {BLOCK_TOKENS}.0), least(source_size, {LEAST_BLOCKS}))::BIGINT AS blocks FROM sources
), leveled AS (
  SELECT *, ((SELECT sum(source_size) FROM sources)::DOUBLE * {share}::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), stopped AS (
  SELECT *, CASE WHEN cap <= level * weight THEN cap ELSE (SELECT arg_min(level, cap / weight) FROM leveled WHERE cap > level * weight) * weight END AS target FROM leveled
), needs AS (
  SELECT *, target / source_size * blocks AS need FROM stopped WHERE source_size > 0
), spans AS (
  SELECT *, sum(need) OVER (ORDER BY rank) / sum(need) OVER () AS high, round(sum(need) OVER ())::BIGINT AS slots FROM needs
), points AS (
  SELECT slot, ((slot::HUGEINT * {GOLDEN}::HUGEINT) % {1 << 64}::HUGEINT)::DOUBLE / {1 << 64}::DOUBLE AS point
  FROM (SELECT unnest(range(1, (SELECT max(slots) FROM spans) + 1)) AS slot)
), dealt AS (
  SELECT slot, (SELECT coalesce(min(rank) FILTER (WHERE point < high), max(rank)) FROM spans) AS rank FROM points
), turns AS (
  SELECT slot, rank, row_number() OVER (PARTITION BY rank ORDER BY slot) - 1 AS nth FROM dealt
), used AS (
  SELECT rank, nth % blocks AS block, count(*) AS times FROM turns JOIN spans USING (rank) WHERE nth < blocks * {most} GROUP BY ALL
), edges AS (
  SELECT rank, block, times, block::HUGEINT * source_size // blocks AS low, (block + 1)::HUGEINT * source_size // blocks AS high FROM used JOIN needs USING (rank)
), taken AS (
  SELECT doc_id, sum(times * (least(e.high, start + size) - greatest(e.low, start)))::BIGINT AS taken
  FROM placed JOIN stopped s ON placed.source IS NOT DISTINCT FROM s.source JOIN edges e ON e.rank = s.rank AND e.low < start + size AND e.high > start
  GROUP BY doc_id
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM placed JOIN stopped s ON placed.source IS NOT DISTINCT FROM s.source LEFT JOIN taken USING (doc_id)"""
