"""BPE encoding and decoding (operator 3) by dynamic programming over prefixes.

For every prefix of a piece, exactly one token can end its byte-pair encoding.  A suffix automaton
of the vocabulary's strings, fed byte by byte, knows all tokens that end at the current byte; of
these, the last token is the one that is compatible with the last token of the prefix before it,
and two tokens are compatible if byte-pair merging of their concatenation gives the two again,
which is decided by unwinding their merges.  Following the last tokens back from the end gives the
ids, the same as by merging.

Encoded pieces are remembered as packed ids (a bounded memory per worker), as words repeat, and each
distinct piece is checked to decode to itself; a text's round trip then holds if its pieces make up the text.
A piece that is itself a token made by merges skips the dynamic programming, whose result is that token.

Defined cases: null texts give null ids; empty texts give an empty list; texts of any length are
encoded whole, in memory that follows one batch of texts; repeated rows are encoded alike.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common as c
from millrace.llm.pretokens import DEFAULT_VOCABULARY, pieces, read_ranks

REMEMBERED = 300_000


class SuffixAutomaton:
    """All substrings of the vocabulary's tokens, with the tokens that end in each state."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.step: dict[int, int] = {}  # state << 8 | byte -> state
        self.link, self.length, leaving = [-1], [0], [b""]
        step, link, length = self.step, self.link, self.length
        for token in ranks:
            last = 0
            for byte in token:
                known = step.get(last << 8 | byte)
                if known is not None and length[known] == length[last] + 1:
                    last = known
                    continue
                if known is None:
                    new = len(link)
                    link.append(0)
                    length.append(length[last] + 1)
                    leaving.append(b"")
                    p = last
                    while p >= 0 and (p << 8 | byte) not in step:
                        step[p << 8 | byte] = new
                        leaving[p] += bytes((byte,))
                        p = link[p]
                else:
                    new, p = None, last
                if p >= 0:
                    q = step[p << 8 | byte]
                    if length[p] + 1 != length[q]:
                        clone = len(link)
                        link.append(link[q])
                        length.append(length[p] + 1)
                        leaving.append(leaving[q])
                        for b in leaving[q]:
                            step[clone << 8 | b] = step[q << 8 | b]
                        while p >= 0 and step.get(p << 8 | byte) == q:
                            step[p << 8 | byte] = clone
                            p = link[p]
                        link[q] = clone
                        q = clone
                    if new is not None:
                        link[new] = q
                    last = q if new is None else new
                else:
                    last = new
        ends: dict[int, list[tuple[int, int]]] = {}
        for token, rank in ranks.items():
            state = 0
            for byte in token:
                state = step[state << 8 | byte]
            ends.setdefault(state, []).append((len(token), rank))
        #: Tokens that are suffixes of the strings of a state, longest first; shared with the states that add none.
        self.tokens: list[tuple[tuple[int, int], ...]] = [()] * len(link)
        for state in sorted(range(1, len(link)), key=length.__getitem__):
            own = ends.get(state)
            inherited = self.tokens[link[state]]
            self.tokens[state] = tuple(sorted(own, reverse=True)) + inherited if own else inherited


class Codec:
    """Encoder and decoder for one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.automaton = SuffixAutomaton(ranks)
        self.parts = {rank: self._last_merge(token, rank) for token, rank in ranks.items()}
        self._compatible: dict[int, bool] = {}
        self._hops: dict[int, tuple[int, int]] = {}  # at most one for every state and byte

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int]:
        """The two tokens that merge into this one; itself twice for a single byte or one that no merge makes."""
        ranks, parts = self.ranks, [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1], rank)
                if r < best:
                    best, at = r, i
            if at < 0:
                return rank, rank
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else (rank, rank)

    def compatible(self, a: int, b: int) -> bool:
        """Whether the concatenation of tokens ``a`` and ``b`` is encoded as just these two."""
        key = a << 32 | b
        known = self._compatible.get(key)
        if known is None:
            if len(self._compatible) > 4 * REMEMBERED:
                self._compatible.clear()
            known = self._compatible[key] = self._unwind(a, b)
        return known

    def _unwind(self, a: int, b: int) -> bool:
        ranks, text, parts = self.ranks, self.bytes_of, self.parts
        limit = 1 << 40  # merges of this rank and above come after the tokens at the seam were made
        while True:
            if ranks.get(text[a] + text[b], limit) < limit:
                return False
            if a > b:
                limit, right = a, parts[a][1]
                if right == a:
                    limit, left = b + 1, parts[b][0]
                    if left == b:
                        return True
                    b = left
                else:
                    a = right
            else:
                limit, left = b + 1, parts[b][0]
                if left == b:
                    limit, right = a, parts[a][1]
                    if right == a:
                        return True
                    a = right
                else:
                    b = left

    def _hop(self, state: int, byte: int) -> tuple[int, int]:
        """Where ``byte`` leads by the suffix links of a state that lacks it, and how much matches there."""
        step, link, length = self.automaton.step, self.automaton.link, self.automaton.length
        start = state << 8 | byte
        while state:
            state = link[state]
            to = step.get(state << 8 | byte)
            if to is not None:
                hop = self._hops[start] = to, length[state] + 1
                return hop
        raise ValueError(f"byte {byte} is in no token")

    def encode_bytes(self, data: bytes) -> tuple[int, ...]:
        step, hops, tokens = self.automaton.step.get, self._hops.get, self.automaton.tokens
        known, compatible = self._compatible.get, self.compatible
        last: list[int] = []
        sizes: list[int] = []
        state = matched = 0
        for i, byte in enumerate(data):
            key = state << 8 | byte
            to = step(key)
            if to is not None:
                state, matched = to, matched + 1
            else:
                state, matched = hops(key) or self._hop(state, byte)
            for size, token in tokens[state]:
                if size <= matched:
                    if size > i:
                        break
                    before = last[i - size]
                    fits = known(before << 32 | token)
                    if fits or fits is None and compatible(before, token):
                        break
            else:
                raise ValueError("no token ends here: the vocabulary lacks a byte")
            last.append(token)
            sizes.append(size)
        out, at = [], len(data) - 1
        while at >= 0:
            out.append(last[at])
            at -= sizes[at]
        return tuple(reversed(out))

    def piece(self, text: str) -> tuple[int, ...]:
        data = text.encode()
        whole = self.ranks.get(data)
        return (whole,) if whole is not None and self.parts[whole][0] != whole else self.encode_bytes(data)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.piece, pieces(text))))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Packed(dict):
    """Ids of pieces as packed 32-bit integers; when full, what was not used since the last time is forgotten.

    ``wrong`` has pieces that do not decode to themselves.
    """

    def __init__(self, codec: Codec) -> None:
        self.codec, self.older = codec, {}
        self.wrong: set[str] = set()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        packed = self.older.get(piece)
        if packed is None:
            ids = self.codec.piece(piece)
            if self.codec.decode(ids) != piece.encode():
                self.wrong.add(piece)
            packed = array("i", ids).tobytes()
        self[piece] = packed
        return packed


_packed: dict[int, Packed] = {}


def _packed_of(ranks_b) -> Packed:
    """The worker's memory and codec for a broadcast vocabulary, built once."""
    key = hash(frozenset(ranks_b.value.items()))
    if key not in _packed:
        _packed.clear()
        _packed[key] = Packed(Codec(ranks_b.value))
    return _packed[key]


def _encode(ranks_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = _packed_of(ranks_b)
        of, wrong = packed.__getitem__, packed.wrong
        for batch in c.slices(batches, "_text"):
            parts, sizes, same = [], [0], []
            for text in batch.column("_text").to_pylist():
                if text is None:
                    sizes.append(0)
                    same.append(None)
                    continue
                mine = pieces(text)
                ids = b"".join(map(of, mine))
                parts.append(ids)
                sizes.append(len(ids) // 4)
                same.append("".join(mine) == text and (not wrong or wrong.isdisjoint(mine)))
            flat = np.frombuffer(b"".join(parts), np.int32)
            missing = pc.invert(batch.column("_text").is_valid()) if batch.column("_text").null_count else None
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(flat), mask=missing)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(same, pa.bool_())], ["doc_id", "token_ids", "round_trip"])

    return run


def encode(df: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, token_ids, n_tokens, round_trip)``: the ids of every text, and whether they decode to it again."""
    ranks_b = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    coded = rows.mapInArrow(_encode(ranks_b), f"doc_id {kind}, token_ids array<int>, round_trip boolean")
    return coded.select("doc_id", "token_ids", F.when(F.col("token_ids").isNotNull(), F.size("token_ids")).alias("n_tokens"), "round_trip")


def _decode(ranks_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_of = {rank: token for token, rank in ranks_b.value.items()}
        for batch in batches:
            texts = [None if ids is None else b"".join(map(text_of.__getitem__, ids)).decode("utf-8", "replace") for ids in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(df: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """``(doc_id, text)`` of token ids; ids that end amid a character give U+FFFD there, null ids a null text."""
    ranks_b = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("_ids"))
    return rows.mapInArrow(_decode(ranks_b), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
