"""Token counts by rank-synchronous merging over ragged arrays."""

from __future__ import annotations

import heapq
import re
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table

BLANK = "▁"
#: Characters of text worked on at once, and pre-token counts remembered, by one worker.
CHUNK_CHARS = 2_000_000
REMEMBERED = 300_000
NEVER = np.int64(1) << 40


class PieceMerger:
    """Counts the pieces that a byte-fallback BPE model of the sentencepiece kind gives."""

    def __init__(self, model_bytes: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): model.get_score(i) for i in plain}
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("pieces with a blank inside need another way to find pre-tokens")
        self.score = pieces
        number = {p: k for k, p in enumerate(pieces)}
        order = {s: k for k, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        self.char = {ord(p): k for p, k in number.items() if len(p) == 1}
        pairs = sorted((number[p[:i]] << 32 | number[p[i:]], order[s], k) for p, s in pieces.items() for k in [number[p]] for i in range(1, len(p)) if p[:i] in number and p[i:] in number)
        self.keys, self.ranks, self.made = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.known: dict[str, int] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NEVER: it doesn't merge) and what it makes."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NEVER), self.made[at]

    def merge(self, tokens: list[str]) -> np.ndarray:
        """How many pieces each pre-token has; none holds a run of blanks or is empty.

        In each round the lowest-ranked pair of every sequence merges wherever
        it occurs in it, left before right where occurrences overlap.
        Sequences without a pair that merges drop out and are counted.
        """
        points = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, inverse = np.unique(points, return_inverse=True)
        utf8 = np.array([len(chr(c).encode("utf-8", "surrogatepass")) for c in kinds.tolist()], np.int64)
        ids = np.array([self.char.get(c, -1) for c in kinds.tolist()], np.int64)
        symbol = ids[inverse]
        weight = np.where(symbol < 0, utf8[inverse], 1)  # a symbol without piece falls back to its bytes
        owner = np.repeat(np.arange(len(tokens)), np.fromiter(map(len, tokens), np.int64, len(tokens)))
        out = np.zeros(len(tokens), np.int64)
        while len(symbol):
            rank, made = self.rank(symbol[:-1], symbol[1:])
            rank[owner[:-1] != owner[1:]] = NEVER
            rank = np.append(rank, NEVER)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(starts, len(owner)))
            low = np.minimum.reduceat(rank, starts)
            done = np.repeat(low == NEVER, sizes)
            hits = (rank == np.repeat(low, sizes)) & ~done
            # of a run of overlapping hits every second merges
            at = np.flatnonzero(hits)
            if len(at):
                first = np.append(True, np.diff(at) > 1)
                nth = np.arange(len(at)) - np.repeat(np.flatnonzero(first), np.diff(np.append(np.flatnonzero(first), len(at))))
                at = at[nth % 2 == 0]
            symbol = symbol.copy()
            symbol[at] = made[at]
            gone = np.zeros(len(symbol), bool)
            gone[at + 1] = True
            out += np.bincount(owner[done], weight[done], len(tokens)).astype(np.int64)
            stay = ~(gone | done)
            symbol, owner, weight = symbol[stay], owner[stay], weight[stay]
        return out

    def one_by_one(self, token: str) -> int:
        """The same for a pre-token with a run of blanks: pieces of blanks share one rank, so pairs merge singly, the leftmost first."""
        parts: list[str | None] = list(token)
        nxt, prv = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str, str]] = []

        def offer(i: int) -> None:
            if 0 <= i and nxt[i] < len(parts):
                a, b = parts[i], parts[nxt[i]]
                if (s := self.score.get(a + b)) is not None and a in self.score and b in self.score:
                    heapq.heappush(heap, (-s, i, a, b))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if parts[i] != a or nxt[i] >= len(parts) or parts[j := nxt[i]] != b:
                continue
            parts[i], parts[j] = a + b, None
            nxt[i] = nxt[j]
            if nxt[j] < len(parts):
                prv[nxt[j]] = i
            offer(i)
            offer(prv[i])
        return sum(1 if p in self.score else len(p.encode("utf-8", "surrogatepass")) for p in parts if p is not None)

    def learn(self, tokens: set[str]) -> None:
        """Remember the counts of pre-tokens: the text after one blank, or with its run of blanks."""
        if len(self.known) + len(tokens) > REMEMBERED:
            self.known.clear()
        runs = [t for t in tokens if t.startswith(BLANK)]
        plain = [t for t in tokens if not t.startswith(BLANK)]
        self.known.update((t, self.one_by_one(t)) for t in runs)
        if plain:
            self.known.update(zip(plain, self.merge([BLANK + t for t in plain]).tolist(), strict=True))

    def count(self, texts: list[str | None]) -> list[int]:
        """Pieces of each text; null and empty texts have none."""
        out: list[int] = []
        chunk: list[list[str]] = []
        size = 0
        for text in texts:
            chunk.append(pre_tokens(text))
            size += len(text or "")
            if size > CHUNK_CHARS:
                out += self._count(chunk)
                chunk, size = [], 0
        return out + self._count(chunk)

    def _count(self, chunk: list[list[str]]) -> list[int]:
        wanted = set().union(*chunk)
        if new := wanted.difference(self.known):
            self.learn(new if len(self.known) + len(new) <= REMEMBERED else wanted)
        get = self.known.__getitem__
        return [sum(map(get, tokens)) for tokens in chunk]


def pre_tokens(text: str | None) -> list[str]:
    """The stretches that merges never leave: a run of blanks and what follows; one blank is left out."""
    if not text:
        return []
    tokens = text.split(" ")
    if "" in tokens or BLANK in text:
        whole = BLANK + text.replace(" ", BLANK)
        return [t if t[1:2] == BLANK else t[1:] for t in re.findall(f"{BLANK}+[^{BLANK}]*", whole)]
    return tokens


@lru_cache(maxsize=2)
def merger(model_bytes: bytes) -> PieceMerger:
    return PieceMerger(model_bytes)


def token_count(text: Column, model_file: str) -> Column:
    """Tokens of each text, as the library counts them without begin, end or added tokens.

    The model file is read here, by the driver, and goes to tasks as bytes.
    """
    model = Path(model_file).read_bytes()

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(merger(model).count(texts.tolist()), dtype="int64")

    return count(text)


def count_tokens(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of docs.

    A null text counts as empty: no bytes, no tokens. Repeated rows stay
    repeated; other columns of docs are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    counted = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), token_count(text, model_file).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document under the 32k piece vocabulary."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
