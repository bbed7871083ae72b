"""Token counts (operator 4) by byte-pair merging with a heap and a linked list.

A piece starts as its bytes, linked to their neighbours.  The heap has the rank of every adjacent
pair that is a token; the lowest is popped again and again, entries whose symbols have changed
since are passed over, and each merge puts the two new neighbouring pairs in.  The count is the
number of bytes less the number of merges: no id is ever made.

Defined cases: null texts have a null count and empty texts 0; texts of any length are counted whole;
a piece of one kind of letter takes n log n time; repeated rows are counted alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common as c
from millrace.llm.pretokens import DEFAULT_VOCABULARY, pieces, read_ranks

REMEMBERED = 300_000


def merged_length(data: bytes, ranks: dict[bytes, int]) -> int:
    """Number of symbols left when no adjacent pair is a token; the lowest rank, leftmost first, merges first."""
    n = len(data)
    if n < 2:
        return n
    end = list(range(1, n + 1))  # of the symbol that starts at i
    before = list(range(-1, n - 1))  # start of the symbol before
    version = [0] * n  # an entry holds only while both of its symbols are as they were
    rank_of = ranks.get
    heap = []
    for i in range(n - 1):
        rank = rank_of(data[i : i + 2])
        if rank is not None:
            heap.append((rank, i, 0, 0))
    heapify(heap)
    merges = 0
    while heap:
        rank, i, left, right = heappop(heap)
        j = end[i]
        if version[i] != left or j >= n or version[j] != right:
            continue
        end[i] = k = end[j]
        version[i] += 1
        version[j] = -1
        merges += 1
        if k < n:
            before[k] = i
            rank = rank_of(data[i : end[k]])
            if rank is not None:
                heappush(heap, (rank, i, version[i], version[k]))
        p = before[i]
        if p >= 0:
            rank = rank_of(data[p:k])
            if rank is not None:
                heappush(heap, (rank, p, version[p], version[i]))
    return n - merges


class Memory(dict):
    """Counts of pieces; when full, what was not used since the last time is forgotten."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.older = ranks, {}

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        n = self.older.get(piece)
        if n is None:
            n = merged_length(piece.encode(), self.ranks)
        self[piece] = n
        return n


_memories: dict[int, Memory] = {}


def _memory(ranks_b) -> Memory:
    """The worker's memory for a broadcast vocabulary, kept from task to task."""
    key = hash(frozenset(ranks_b.value.items()))
    if key not in _memories:
        _memories.clear()
        _memories[key] = Memory(ranks_b.value)
    return _memories[key]


def _count(ranks_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _memory(ranks_b).__getitem__
        for batch in c.slices(batches, "_text"):
            counts = [None if t is None else sum(map(of, pieces(t))) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return run


def count_tokens(df: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens)`` of every row."""
    ranks_b = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(_count(ranks_b), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens bigint")
