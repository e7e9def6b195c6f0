"""LM scoring by a class-based bigram model whose classes come from exchange clustering.

Words are hashed to 64 bits (XXH64) on the JVM side; the hashes stand for the
words from then on. The most frequent words, a bounded number, are the head:
every task knows their class and count. Of all other words the classes and
counts stay in tables and come by joins, so no word of the corpus is left out
and what is gathered grows with it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import batches_of, cut_lineage, table, written

#: Words whose class and count every task knows.
HEAD_WORDS = 131_072
#: Words whose classes are found one by one, as a start for all others, and passes over them.
SEED_WORDS, SEED_PASSES = 1022, 4
#: Classes; the last two hold unknown words and the end of a text.
CLASSES = 64
#: Passes of parallel exchange over all head words.
PASSES = 2
#: Texts that a Python worker holds at once.
BATCH = 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", "abcdefghijklmnopqrstuvwxyz     "


def words_in(text: Column) -> Column:
    """The words of a text, A-Z in lower case."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), " "), "")


def exchange_clusters(pairs: np.ndarray, classes: int = CLASSES, passes: int = SEED_PASSES) -> np.ndarray:
    """The class of each unit, by exchange on the unit bigram counts pairs; the last two units stay alone in the last two classes.

    Each unit in turn moves to the class that raises the bigram class
    likelihood most, until a pass moves none or passes are done.
    """
    units = len(pairs)
    freq = pairs.sum(0) + pairs.sum(1)
    of = np.zeros(units, np.int64)
    order = np.argsort(-freq[:-2], kind="stable")
    of[order] = np.arange(units - 2) % max(1, classes - 2)
    of[-2:] = classes - 2, classes - 1
    member = np.zeros((units, classes))
    member[np.arange(units), of] = 1
    h = lambda x: x * np.log(np.maximum(x, 1))
    right, left = pairs @ member, (pairs.T @ member)  # counts of each unit before, after each class
    table_ = member.T @ right
    for _ in range(passes):
        moved = 0
        for u in order:
            if not freq[u]:
                continue
            a, own = of[u], pairs[u, u]
            r, l = right[u].copy(), left[u].copy()  # noqa: E741
            table_[a] -= r
            table_[:, a] -= l
            table_[a, a] += own
            r[a] -= own
            l[a] -= own
            base = h(table_)
            rows, cols = h(table_ + r[None, :]) - base, h(table_ + l[:, None]) - base
            gain = rows.sum(1) + cols.sum(0) - np.diag(rows) - np.diag(cols)
            diag = np.diag(table_)
            gain += h(diag + r + l + own) - h(diag)
            out, into = table_.sum(1) + l, table_.sum(0) + r  # u is somewhere whatever its class
            gain -= h(out + r.sum() + own) - h(out) + h(into + l.sum() + own) - h(into)
            gain[classes - 2 :] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table_[b] += r
            table_[:, b] += l
            table_[b, b] += own
            if b != a:
                moved += 1
                of[u] = b
                right[:, a] -= pairs[:, u]
                right[:, b] += pairs[:, u]
                left[:, a] -= pairs[u]
                left[:, b] += pairs[u]
        if not moved:
            break
    return of


@dataclass
class Head:
    """The most frequent words, numbered by frequency; number size is the end of a text, size + 1 any other word."""

    hashes: np.ndarray
    counts: np.ndarray
    ordered: np.ndarray = field(init=False)
    number: np.ndarray = field(init=False)

    def __post_init__(self):
        by_hash = np.argsort(self.hashes)
        self.ordered, self.number = self.hashes[by_hash], by_hash.astype(np.int32)

    @property
    def size(self) -> int:
        return len(self.hashes)

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        if not self.size:
            return np.full(len(hashes), 1, np.int32)
        at = np.minimum(np.searchsorted(self.ordered, hashes), self.size - 1)
        return np.where(self.ordered[at] == hashes, self.number[at], np.int32(self.size + 1))


def head_of(counts: DataFrame, most: int = HEAD_WORDS) -> Head:
    """The most frequent words, at most most of them: all above a count found from a histogram by logarithm."""
    step = F.floor(F.log2("n") * 16)
    histogram = sorted(((r[0], r[1]) for r in counts.groupBy(step.alias("k")).count().collect()), reverse=True)
    low, held = None, 0
    for k, n in histogram:
        if held + n > most:
            break
        low, held = k, held + n
    if low is None:
        return Head(np.zeros(0, np.int64), np.zeros(0, np.int64))
    rows = counts.where(step >= low).toArrow()
    h, n = rows["h"].to_numpy(), rows["n"].to_numpy()
    order = np.lexsort((h, -n))
    return Head(h[order], n[order])


def encoded_rows(rows: DataFrame, head: Head) -> DataFrame:
    """rows (id, held_out, text) as (row, id, held_out, codes, rare), written: head numbers, and the hashes of other words in text order."""
    kind = dict(rows.dtypes)["id"]
    hashed = rows.select(F.monotonically_increasing_id().alias("row"), "id", "held_out", F.transform(words_in(F.col("text")), lambda w: F.xxhash64(w)).alias("tokens"))

    def encode(batches):
        for b in batches:
            tokens = b.column("tokens")
            flat, ends = tokens.flatten().to_numpy(zero_copy_only=False), tokens.offsets.to_numpy().astype(np.int64)
            ends = ends - ends[0]
            codes = head.encode(flat)
            other = codes > head.size
            gone = np.concatenate([[0], np.cumsum(other)])[ends]
            made = [as_binary(codes, ends, 4), as_binary(flat[other], gone, 8)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *made], [*b.schema.names[:3], "codes", "rare"])

    return written(hashed.mapInArrow(encode, f"row long, id {kind}, held_out boolean, codes binary, rare binary"))


def as_binary(values: np.ndarray, ends: np.ndarray, width: int) -> pa.Array:
    """The stretches of values between ends as byte strings."""
    offsets = pa.array(ends * width, pa.int64())
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())


def numbers_in(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of byte strings, and how many each string has."""
    parts = [x.as_py() for x in column]
    return np.frombuffer(b"".join(parts), kind), np.array([len(p) for p in parts], np.int64) // np.dtype(kind).itemsize


def token_row(batch: pa.RecordBatch, head: Head) -> tuple[np.ndarray, np.ndarray]:
    """The codes of a batch in one row, each text followed by an end, and where those ends lie."""
    codes, sizes = numbers_in(batch.column("codes"), np.int32)
    ends = np.cumsum(sizes + 1) - 1
    out = np.full(len(codes) + len(sizes), head.size, np.int32)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = codes
    return out, ends


def before(tokens: np.ndarray, head: Head) -> np.ndarray:
    """The code before each token; an end stands before the first."""
    return np.concatenate([[head.size], tokens[:-1]])


def pair_counts(train: DataFrame, head: Head, unit: np.ndarray, size: int) -> np.ndarray:
    """How often a token of unit i stands before one of unit j; unit gives each code's."""

    def count(batches):
        held = np.zeros(size * size, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            tokens, _ = token_row(b, head)
            held += np.bincount(unit[before(tokens, head)].astype(np.int64) * size + unit[tokens], minlength=size * size)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["k", "n"])

    rows = train.select("codes").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[rows["k"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(size, size)


def log_moves(pairs: np.ndarray) -> np.ndarray:
    """log10 of the class transition probabilities, one half added to each count."""
    pairs = pairs + 0.5
    return np.log10(pairs / pairs.sum(1, keepdims=True))


def best_class(words: DataFrame, key: str, weights: np.ndarray, classes: int) -> DataFrame:
    """(key, n, cls, at): the class for which the contexts of a word (at: array of ctx, m) weigh most, the first of equal ones."""

    def choose(batches):
        for b in batches:
            lists = b.column("at")
            ctx, m = (lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(2))
            held = np.zeros((b.num_rows, len(weights)))
            held[np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy())), ctx] = m
            cls = np.argmax((held @ weights)[:, : classes - 2], 1)
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("n"), pa.array(cls.astype(np.int32)), lists], [key, "n", "cls", "at"])

    return words.select(key, "n", "at").mapInArrow(choose, f"{key} long, n long, cls int, at array<struct<ctx:int,m:long>>")


def exchange_pass(train: DataFrame, head: Head, of: np.ndarray, classes: int) -> np.ndarray:
    """The classes of all codes after one pass of parallel exchange.

    For each head word the classes before and after its occurrences are
    counted over all training texts; then every word goes to the class under
    whose present transitions and size its occurrences are likeliest.
    """
    moves = log_moves(pair_counts(train, head, of, classes))
    room = np.log10(np.maximum(class_sizes(head, of, classes), 1))
    weights = np.vstack([moves - room[None, :], moves.T])
    wide = 2 * classes

    def count(batches):
        held = np.zeros(head.size * wide, np.int32)
        for b in batches:
            if not b.num_rows:
                continue
            tokens, _ = token_row(b, head)
            cls = of[tokens]
            at = np.flatnonzero(tokens < head.size)
            word = tokens[at].astype(np.int64) * wide
            keys, n = np.unique(np.concatenate([word + of[before(tokens, head)][at], word + classes + np.append(cls, classes - 1)[at + 1]]), return_counts=True)
            held[keys] += n.astype(np.int32)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at // wide), pa.array((at % wide).astype(np.int32)), pa.array(held[at].astype(np.int64))], ["word", "ctx", "m"])

    cells = train.select("codes").mapInArrow(count, "word long, ctx int, m long").groupBy("word", "ctx").agg(F.sum("m").alias("m"))
    words = cells.groupBy("word").agg((F.sum("m") / 2).cast("long").alias("n"), F.collect_list(F.struct("ctx", "m")).alias("at"))
    found = best_class(words, "word", weights, classes).select("word", "cls").toArrow()
    out = of.copy()
    out[found["word"].to_numpy()] = found["cls"].to_numpy()
    return out


def class_sizes(head: Head, of: np.ndarray, classes: int) -> np.ndarray:
    return np.bincount(of[: head.size], head.counts, classes)


def rare_words(train: DataFrame, head: Head, of: np.ndarray, weights: np.ndarray, classes: int) -> DataFrame:
    """(h, n, cls, at) of every training word outside the head; at has the classes before its occurrences.

    A word goes to the class that these contexts make likeliest.
    """

    def emit(batches):
        for b in batches:
            if not b.num_rows:
                continue
            tokens, _ = token_row(b, head)
            hashes, _ = numbers_in(b.column("rare"), np.int64)
            ctx = of[before(tokens, head)][tokens > head.size]
            order = np.lexsort((ctx, hashes))
            hashes, ctx = hashes[order], ctx[order]
            new = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (ctx[1:] != ctx[:-1]))) if len(hashes) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[new]), pa.array(ctx[new].astype(np.int32)), pa.array(np.diff(np.append(new, len(hashes))))], ["h", "ctx", "m"])

    places = train.select("codes", "rare").mapInArrow(emit, "h long, ctx int, m long")
    cells = places.repartition("h").groupBy("h", "ctx").agg(F.sum("m").alias("m"))
    words = cells.groupBy("h").agg(F.sum("m").alias("n"), F.collect_list(F.struct("ctx", "m")).alias("at"))
    return written(best_class(words, "h", weights, classes))


@dataclass
class Model:
    head: Head
    of: np.ndarray  # class of each code
    end_count: int
    tokens: int
    distinct: int
    moves: np.ndarray  # log10 of class transitions
    room: np.ndarray  # log10 of each class's emission denominator
    rare: DataFrame | None  # (h, n, cls) of the words outside the head


def fit(encoded: DataFrame, head: Head, ends: int, classes: int = CLASSES, seeds: int = SEED_WORDS, passes: int = PASSES) -> Model:
    """The model of the training rows of encoded, whose number is ends."""
    train = encoded.where("not held_out")
    other, end = classes - 2, classes - 1
    few = min(seeds, head.size)
    unit = np.minimum(np.arange(head.size + 2), few)
    unit[head.size] = few + 1
    unit[head.size + 1] = few
    of_unit = exchange_clusters(pair_counts(train, head, unit, few + 2), classes)
    of = of_unit[unit].astype(np.int32)
    for _ in range(passes if head.size else 0):
        of = exchange_pass(train, head, of, classes)
    pairs = pair_counts(train, head, of, classes)
    known = class_sizes(head, of, classes)
    weights = log_moves(pairs) - np.log10(np.maximum(known, 1))[None, :]
    rare = rare_words(train, head, of, weights, classes)
    for ctx, cls, m in rare.select("cls", F.explode("at").alias("a")).groupBy("a.ctx", "cls").agg(F.sum("a.m")).collect():
        pairs[ctx, other] -= m
        pairs[ctx, cls] += m
    held = np.zeros((classes, 2))
    held[:, 0], held[:, 1] = known, np.bincount(of[: head.size], minlength=classes)
    for c, n, v in rare.groupBy("cls").agg(F.sum("n"), F.count("*")).collect():
        held[c] += n, v
    held[end] += ends, int(ends > 0)
    unknown = np.zeros(classes)
    unknown[other] = 1
    return Model(head, of, ends, int(held[:, 0].sum()), int(held[:, 1].sum()), log_moves(pairs), np.log10(np.maximum(held.sum(1) + unknown, 1)), rare.select("h", "n", "cls"))


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD_WORDS, **options) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    Rows that are not held_out train the model. base_score is the add-one
    unigram log10 probability; score that of the class bigram model, where a
    token has probability P(class | context) * (n + 1) / (N + V): the context
    is the class of the token before (that of unknown words if it is no head
    word), n the token's training count, N and V the training tokens and
    distinct words of its class. Unknown words have a class with one place.
    Null and empty texts are one end token. Repeated rows stay repeated and
    count each; an empty table gives an empty result; other columns of docs
    are not read. Without training rows both scores are those of an empty
    model.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = rows.where("not held_out").select(F.explode(words_in(F.col("text"))).alias("word"))
    counts = cut_lineage(words.select(F.xxhash64("word").alias("h")).groupBy("h").agg(F.count("*").alias("n")))
    head = head_of(counts, head_words)
    with batches_of(docs.sparkSession, BATCH):  # every Python step ends in a file, a checkpoint or the driver
        encoded = encoded_rows(rows, head)
        model = fit(encoded, head, encoded.where("not held_out").count(), **options)
        return scored(encoded, model)


def scored(encoded: DataFrame, model: Model) -> DataFrame:
    head, of, moves, room = model.head, model.of, model.moves, model.room
    classes, other = len(room), len(room) - 2
    total = float(np.log10(model.tokens + model.distinct + 1.0))
    log_count = np.log10(np.concatenate([head.counts, [model.end_count, 0]]) + 1.0)
    known = np.append(np.ones(head.size, bool), [model.end_count > 0, False])

    def score(batches):
        for b in batches:
            if not b.num_rows:
                continue
            tokens, ends = token_row(b, head)
            hashes, n_rare = numbers_in(b.column("rare"), np.int64)
            ctx, cls = of[before(tokens, head)], of[tokens]
            starts = np.concatenate([[0], ends[:-1] + 1])
            sums = lambda x: np.add.reduceat(x, starts)  # noqa: E731, B023
            size = (ends - starts + 1).astype(np.int64)
            base = sums(log_count[tokens])
            classed = base + sums(moves[ctx, cls] - room[cls])
            offsets = np.concatenate([[0], np.cumsum(n_rare)]).astype(np.int32)
            met = pa.StructArray.from_arrays([pa.array(hashes), pa.array(ctx[tokens > head.size].astype(np.int32))], ["h", "ctx"])
            made = [pa.array(size), pa.array(sums(known[tokens].astype(np.int64))), pa.array(base - size * total), pa.array(classed), pa.ListArray.from_arrays(pa.array(offsets), met)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *made], [*b.schema.names[:3], "n_tokens", "known", "base", "classed", "rare"])

    kind = dict(encoded.dtypes)["id"]
    first = cut_lineage(encoded.select("row", "id", "held_out", "codes", "rare").mapInArrow(score, f"row long, id {kind}, held_out boolean, n_tokens long, known long, base double, classed double, rare array<struct<h:long,ctx:int>>"))
    step = (moves - room[None, :]) - (moves[:, other] - room[other])[:, None]
    changed = F.get(F.lit(step.ravel().tolist()), F.col("ctx") * classes + F.col("cls"))
    found = first.select("row", F.explode("rare").alias("r")).select("row", "r.*").join(model.rare, "h")
    counted = F.log10(F.col("n") + 1)
    added = found.groupBy(F.col("row").alias("of_row")).agg(F.sum(counted).alias("more"), F.sum(counted + changed).alias("shift"), F.count("*").alias("also"))
    whole = first.drop("rare").join(added, F.col("row") == F.col("of_row"), "left")
    zero = F.lit(0.0)
    return whole.select("id", "held_out", "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", zero)).alias("base_score"), (F.col("classed") + F.coalesce("shift", zero)).alias("score"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document; those whose crc32(doc_id) mod 7 is 2 are held out."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return score_texts(table(spark, sf_dir, "documents"), held_out).withColumnRenamed("id", "doc_id")
