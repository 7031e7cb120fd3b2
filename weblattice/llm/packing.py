"""Documents into containers of a fixed number of tokens, balanced by cost.

The cost of a sequence of n tokens is estimated as ``linear·n + quadratic·n²``
summed over its documents (attention stays inside a document). Items go, in
descending length, to the cheapest sequence with room left. As many sequences
are opened as the tokens need; another only when an item fits nowhere.

Work is spread over shards of about ``shard_rows`` documents by a hash of the
key. Shards know nothing of each other; each wastes at most the room of its
last few sequences, a share that doesn't grow with the data.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

_encoders: dict = {}


def encoder(path: str = VOCABULARY):
    """The public byte-pair vocabulary at ``path``, loaded once per worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # Fixed value: the pattern published with these vocabularies.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        _encoders[path] = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) of each row; null and empty texts have none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=["_k", "n_tokens"])

    rows = docs.select(F.col(key).alias("_k"), F.col(text))
    return rows.mapInArrow(run, f"_k {rows.schema['_k'].dataType.simpleString()}, n_tokens long").withColumnRenamed("_k", key)


class Rooms:
    """The cheapest open sequence with at least so much room: a tree of minima over room left."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.best = [float("inf")] * (2 * self.width)
        self.heaps: list[list] = [[] for _ in range(self.width)]

    def add(self, room: int, cost: float, seq: int) -> None:
        import heapq

        heapq.heappush(self.heaps[room], (cost, seq))
        self._lift(room)

    def take(self, least: int) -> tuple[float, int, int] | None:
        """Removes and gives (cost, sequence, room) of the cheapest with room for ``least``."""
        import heapq

        lo, hi, found = least + self.width, 2 * self.width, 0
        while lo < hi:
            if lo & 1:
                if not found or self.best[lo] < self.best[found]:
                    found = lo
                lo += 1
            if hi & 1:
                hi -= 1
                if not found or self.best[hi] < self.best[found]:
                    found = hi
            lo >>= 1
            hi >>= 1
        if not found or self.best[found] == float("inf"):
            return None
        while found < self.width:
            found = 2 * found if self.best[2 * found] <= self.best[2 * found + 1] else 2 * found + 1
        room = found - self.width
        cost, seq = heapq.heappop(self.heaps[room])
        self._lift(room)
        return cost, seq, room

    def _lift(self, room: int) -> None:
        i = room + self.width
        self.best[i] = self.heaps[room][0][0] if self.heaps[room] else float("inf")
        i >>= 1
        while i:
            self.best[i] = min(self.best[2 * i], self.best[2 * i + 1])
            i >>= 1


def assign(sizes: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[int]:
    """The sequence of each item, none larger than ``capacity``; items come in descending order."""
    rooms = Rooms(capacity)
    used = -(-int(sizes.sum()) // capacity)
    for s in range(used):
        rooms.add(capacity, 0.0, s)
    out = []
    for n in map(int, sizes):
        got = rooms.take(n)
        if got is None:
            got, used = (0.0, used, capacity), used + 1
        cost, seq, room = got
        out.append(seq)
        rooms.add(room - n, cost + linear * n + quadratic * n * n, seq)
    return out


def packed(
    counts: DataFrame, key: str = "doc_id", capacity: int = 1024, linear: float = 1.0, quadratic: float = 1.0 / 1024, shard_rows: int = 16_384,
    rows: int | None = None,
) -> DataFrame:
    """(key, piece, container, position, n_tokens): where each document's tokens go.

    A document larger than ``capacity`` is cut into full pieces, each a
    container of its own, and a rest packed like a document; all others stay
    whole. Documents without tokens get one row with a null container.
    ``position`` is the first token's place in the container. Ties in length
    go by key. Repeated keys are items of their own.
    """
    rows = counts.count() if rows is None else rows
    shards = max(1, -(-rows // shard_rows))
    salted = counts.select(F.col(key).alias("k"), "n_tokens").withColumn("shard", F.pmod(F.xxhash64("k", "n_tokens"), F.lit(shards)).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0]) if len(pdf) else 0
        by_key = pd.factorize(pdf["k"], sort=True)[0]  # null keys, if any, come first
        order = np.lexsort((pdf["n_tokens"], by_key))  # rows arrive in any order
        pdf, by_key = pdf.iloc[order], by_key[order]
        keys, sizes = pdf["k"].array, pdf["n_tokens"].to_numpy()
        full = sizes // capacity
        full = np.where(sizes == capacity, 0, full)
        rest = sizes - full * capacity
        place = np.flatnonzero(rest > 0)
        place = place[np.lexsort((by_key[place], -rest[place]))]
        seqs = np.array(assign(rest[place], capacity, linear, quadratic), dtype=np.int64)
        order = np.argsort(seqs, kind="stable")
        sorted_seq, sorted_rest = seqs[order], rest[place][order]
        start = np.cumsum(sorted_rest) - sorted_rest
        first = np.r_[True, sorted_seq[1:] != sorted_seq[:-1]] if len(order) else np.zeros(0, bool)
        position = np.empty(len(order), dtype=np.int64)
        position[order] = start - np.maximum.accumulate(np.where(first, start, 0)) if len(order) else start
        next_seq = int(seqs.max()) + 1 if len(seqs) else 0
        who = np.repeat(np.arange(len(sizes)), full)
        base = shard << 40
        parts = [
            pd.DataFrame({"k": keys[place], "piece": full[place], "container": base + seqs, "position": position, "n_tokens": rest[place]}),
            pd.DataFrame(
                {"k": keys[who], "piece": np.arange(len(who)) - np.repeat(np.cumsum(full) - full, full), "container": base + next_seq + np.arange(len(who)),
                 "position": np.zeros(len(who), np.int64), "n_tokens": np.full(len(who), capacity)}
            ),
        ]
        none = np.flatnonzero(sizes == 0)
        out = pd.concat(parts).astype({"container": "Int64", "position": "Int64"})
        if len(none):
            empty = pd.DataFrame({"k": keys[none], "piece": 0, "container": pd.array([None] * len(none), "Int64"), "position": pd.array([None] * len(none), "Int64"), "n_tokens": 0})
            out = pd.concat([out, empty])
        return out

    schema = f"k {salted.schema['k'].dataType.simpleString()}, piece long, container long, position long, n_tokens long"
    return salted.groupBy("shard").applyInPandas(pack, schema).withColumnRenamed("k", key)


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 1024, vocabulary: str = VOCABULARY, **kwargs) -> DataFrame:
    """Token counts, then :func:`packed`. The number of shards comes from counting the rows, so texts are tokenised once."""
    return packed(token_counts(docs, key, text, vocabulary), key, capacity, rows=docs.count(), **kwargs)
