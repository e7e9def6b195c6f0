"""What the training-data operators share: tables, words, links and checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, everywhere in this subpackage.
SPACE = r"[\x20\x09-\x0D]"
#: For bytes.translate: A-Z to lower case, white space to one kind of blank.
FOLD = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\x09\x0a\x0b\x0c\x0d",
    b"abcdefghijklmnopqrstuvwxyz     ",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster; one of our own only in local mode, where the session names none (as in tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder; for narrow rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet into the shared folder and read again; for rows with texts, which Parquet compresses."""
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python workers get at most rows rows at once in what is run (not only planned) inside; all rows still go through.

    The session's setting, or its being unset, comes back afterwards.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def fresh(columns: list[str], *names: str) -> list[str]:
    """names, each with underscores before it until no column has it, whatever its case."""
    held, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in held:
            name = "_" + name
        held.add(name.lower())
        out.append(name)
    return out


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bind(value: Column, body) -> Column:
    """body(value), with value computed once a row and not once a use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node reachable.

    Large-star and small-star steps alternate until the edges form stars. A
    hub's neighbours meet only in a partial minimum and in a join that can be
    split, so one component may hold any share of the nodes. Each round is
    checkpointed, and so are the edges, which are made once. Nodes are numbers of
    any one type. Empty edges give no rows; loops give a node of its own.
    """
    spread = edges.select("a", "b").where("a is not null and b is not null")
    spread = cut_lineage(spread.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    loops, now = spread.where("a = b").select("a"), spread.where("a <> b")
    mark = None
    while True:
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if (row[0], row[1]) == mark or row[0] == 0:
            break
        mark = (row[0], row[1])
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("a", "b", "m")
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = cut_lineage(small.where("a <> b").distinct())
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    nodes = nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    alone = loops.join(nodes, loops["a"] == nodes["node"], "left_anti").select(F.col("a").alias("node"), F.col("a").alias("root"))
    return nodes.union(alone)
