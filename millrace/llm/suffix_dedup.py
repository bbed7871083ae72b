"""Suffix-array deduplication (operator 8) with a logarithmic family of indexes.

The text is a sequence of words.  Suffixes are sampled by their content: a suffix enters the arrays
if the hash of its first ``KEY_WORDS`` words is the least among ``WINDOW`` suffixes in a row around
it, wherever these lie.  A passage of ``min_words`` words holds such a window in full, so both copies
of it are sampled at the same place, and nothing that long is missed; about one suffix in 17 enters.

A batch of documents gets a suffix array: its sampled suffixes, ordered by their first words (as
hashed), written range-partitioned and sorted.  The family holds arrays by level; a new batch is
merge-scanned against every array in it for suffixes that begin alike, and is then added: two arrays
of one level merge into one of the next, so that there are at most log2(batches) arrays and each
suffix is rewritten as often.  An array keeps the earliest suffix of those that begin alike, so what
thousands of documents share is one entry.  ``SuffixIndex.save`` and ``load`` carry a family over to
another session, where later batches are added.

A stretch's anchor is the least suffix in it, which is sampled for its content alone.  The anchors that more than one
document has are known to the workers as a table of bits (at most 64 MB; it may take in too many, never too few), so
that texts are read again where they are and never shuffled.  All stretches of ``min_words`` words with such an anchor
are compared by 64-bit hashes, packed by anchor; every one that an earlier document has is a repeat, repeats in a row
are joined, and each is reported with the place of its earliest copy.  The rows are in number linear in the repeats.
Stretches whose anchor begins more than ``HOT`` suffixes (license lines, boilerplate) are counted, aggregated before
the shuffle, and those that more than ``HOT`` places have get their earliest copy by a join, so that no group that
comes to one task is larger.

Defined cases: null and short texts (under ``min_words`` words) repeat nothing; case, punctuation and
white space don't count, only words do; what a document repeats of itself alone is no repeat; rows
that repeat an id are documents of their own; the earliest document is that of the least id, in the order of
ids of any type, null last; offsets are 0-based and count words; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import common as c

MIN_WORDS, KEY_WORDS, BATCHES = 50, 18, 4
#: Equal suffixes or stretches, beyond which these are aggregated before the shuffle.
HOT = 100_000
_ENTRY = "key bigint, _rid bigint, pos int"


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` (minimum or maximum) over every run of ``width``, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = op(x[:-step], x[step:])
        have += step
    return x


def sampled(symbols: np.ndarray, offsets: np.ndarray, key_words: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(keys, documents, positions)`` of the suffixes that enter the arrays."""
    keys = c.Rolling(symbols).runs(key_words)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if len(keys) < window:
        at = np.nonzero(doc[: len(keys)] == doc[key_words - 1 :])[0] if len(keys) else np.zeros(0, np.int64)
    else:
        whole = doc[: len(keys)] == doc[key_words - 1 :]
        keys = np.where(whole, keys, np.uint64(0xFFFFFFFFFFFFFFFF))
        least = _sliding(keys, window, np.minimum)
        padded = np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)])
        at = np.nonzero((_sliding(padded, window, np.maximum) == keys) & whole)[0]
    return keys[at], doc[at], at - offsets[doc[at]]


def _suffixes(key_words: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.slices(batches, "_text", 2 * c.SLICE_BYTES):
            codes, offsets, words = c.split_words(batch.column("_text"))
            keys, doc, pos = sampled(c.hash_words(words)[codes], offsets, key_words, window)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column("_rid").take(pa.array(doc)), pa.array(pos.astype(np.int32))], ["key", "_rid", "pos"])

    return run


class SuffixIndex:
    """The family of suffix arrays: tables in the shared folder, by level."""

    def __init__(self, spark: SparkSession, min_words: int = MIN_WORDS, key_words: int = KEY_WORDS) -> None:
        if not 1 <= key_words <= min_words:
            raise ValueError("key_words must be between 1 and min_words")
        self.spark, self.min_words, self.key_words = spark, min_words, key_words
        self.levels: dict[int, DataFrame] = {}

    def suffixes(self, rows: DataFrame) -> DataFrame:
        """Sampled suffixes ``(key, _rid, pos)`` of ``rows (_rid, _text)``."""
        return rows.select("_rid", "_text").mapInArrow(_suffixes(self.key_words, self.min_words - self.key_words + 1), _ENTRY)

    @staticmethod
    def _array(suffixes: DataFrame) -> DataFrame:
        """Sorted, with the earliest of the suffixes that begin alike, the last document that has one, and their number."""
        ranged = suffixes.repartitionByRange("key")  # the one shuffle: equal keys are in one range
        first = ranged.groupBy("key").agg(F.min("_rid").alias("_rid"), F.max("last").alias("last"), F.sum("n").alias("n"))
        return c.stored(first.sortWithinPartitions("key"), "array")

    def add(self, suffixes: DataFrame) -> DataFrame:
        """Merge-scan a batch against the family, then add it.  Returns the keys that more than one document now has and that this batch brought, scanned when they are read."""
        parts = suffixes.select("key", "_rid", F.col("_rid").alias("last"), F.lit(1).cast("bigint").alias("n"))
        mine = parts.groupBy("key").agg(F.min("_rid").alias("_rid"), F.max("last").alias("last"))
        met = mine.where("_rid <> last").select("key")
        for array in self.levels.values():
            met = met.unionByName(mine.select("key", F.col("_rid").alias("r")).join(array.select("key", F.col("_rid").alias("s")).hint("merge"), "key").where("r <> s").select("key"))
        met = met.distinct()
        level = 0
        while level in self.levels:  # all levels that merge are shuffled together, once
            parts = parts.unionByName(self.levels.pop(level))
            level += 1
        self.levels[level] = self._array(parts)
        return met

    def shared(self) -> DataFrame:
        """Keys of the family that more than one document has: arrays know it of their own, and are scanned together where they are several."""
        every = None
        for array in self.levels.values():
            part = array.select("key", "_rid", "last")
            every = part if every is None else every.unionByName(part)
        if len(self.levels) > 1:
            every = every.groupBy("key").agg(F.min("_rid").alias("_rid"), F.max("last").alias("last"))
        return every.where("_rid <> last").select("key")

    def hot(self, most: int) -> DataFrame:
        """Keys that begin more than ``most`` suffixes of the family."""
        every = None
        for array in self.levels.values():
            part = array.select("key", "n")
            every = part if every is None else every.unionByName(part)
        return every.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > most).select("key")

    def save(self, folder: str) -> None:
        """Write the family below ``folder``; what a save was interrupted in isn't read, as levels are listed last."""
        version = uuid.uuid4().hex
        for level, array in self.levels.items():
            array.write.parquet(f"{folder}/{version}/{level}")
        listed = [(self.min_words, self.key_words, version, level) for level in self.levels]
        self.spark.createDataFrame(listed, "min_words int, key_words int, version string, level int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/levels")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> SuffixIndex:
        listed = spark.read.parquet(f"{folder}/levels").collect()
        index = cls(spark, *(listed[0][:2] if listed else ()))
        index.levels = {r["level"]: spark.read.parquet(f"{folder}/{r['version']}/{r['level']}") for r in listed}
        return index


#: Keys that are shared take so many bits each in the table that the workers look them up in, and the table at most 2 ** MOST_BITS.
KEY_BITS, MOST_BITS = 16, 29
#: Stretches in a row that one packed row holds at most.
RUN = 256
_SIGN = np.uint64(1 << 63)


class KeyTable:
    """A set of keys by their first bits.  It may hold keys that were not put in, and lacks none that were."""

    def __init__(self, keys: DataFrame) -> None:
        wanted = max(keys.count() * KEY_BITS, 1 << 16)
        self.shift = 64 - min((wanted - 1).bit_length(), MOST_BITS)
        self.table = np.zeros(1 << (61 - self.shift), np.uint8)
        for r in keys.mapInArrow(self._pieces(self.shift), "at bigint, piece binary").toLocalIterator():
            piece = np.frombuffer(r["piece"], np.uint8)
            self.table[r["at"] : r["at"] + len(piece)] |= piece

    @staticmethod
    def _pieces(shift: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bits = np.unique((c.ints(batch.column("key")).view(np.uint64) ^ _SIGN) >> np.uint64(shift)).astype(np.int64)
                at, of = np.unique(bits >> 3, return_inverse=True)
                values = np.bincount(of, weights=1 << (bits & 7)).astype(np.uint8)
                starts = np.append(0, np.nonzero(np.diff(at) > 64)[0] + 1) if len(at) else np.zeros(0, np.int64)
                pieces = []
                for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(at)]):
                    piece = np.zeros(at[j - 1] - at[i] + 1, np.uint8)
                    piece[at[i:j] - at[i]] = values[i:j]
                    pieces.append(piece.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(at[starts]), pa.array(pieces, pa.binary())], ["at", "piece"])

        return run


def _among(keys: np.ndarray, table: np.ndarray, shift: int) -> np.ndarray:
    bits = ((keys ^ _SIGN) >> np.uint64(shift)).astype(np.int64)
    return (table[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 > 0


def _stretches(min_words: int, key_words: int, known_b, hot: bool):
    """Stretches of ``min_words`` words whose anchor is shared: one by one if it is hot (``hot``), else packed, those in a row with one anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, shift, hot_keys = known_b.value
        for batch in c.slices(batches, "_text"):
            codes, offsets, words = c.split_words(batch.column("_text"))
            if len(codes) < min_words:
                continue
            rolling = c.Rolling(c.hash_words(words)[codes])
            hashes = rolling.runs(min_words)
            anchors = _sliding(rolling.runs(key_words), min_words - key_words + 1, np.minimum)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            at = np.nonzero((doc[: len(hashes)] == doc[min_words - 1 :]) & _among(anchors, table, shift))[0]
            often = np.isin(anchors[at].view(np.int64), hot_keys)
            at = at[often if hot else ~often]
            owner, keys = doc[at], anchors[at].view(np.int64)
            pos = (at - offsets[owner]).astype(np.int32)
            if hot:
                yield pa.RecordBatch.from_arrays([pa.array(hashes[at].view(np.int64)), batch.column("_rid").take(pa.array(owner)), pa.array(pos)], ["key", "_rid", "pos"])
            elif len(at):
                new = np.append(True, (np.diff(at) != 1) | (np.diff(owner) != 0) | (keys[1:] != keys[:-1]))
                begun = np.nonzero(new)[0]
                new |= (np.arange(len(at)) - np.repeat(begun, np.diff(np.append(begun, len(at))))) % RUN == 0
                starts = np.nonzero(new)[0]
                ends = pa.py_buffer((np.append(starts, len(at)) * 8).astype(np.int32))
                packed = pa.Array.from_buffers(pa.binary(), len(starts), [None, ends, pa.py_buffer(hashes[at])])
                yield pa.RecordBatch.from_arrays([pa.array(keys[starts]), batch.column("_rid").take(pa.array(owner[starts])), pa.array(pos[starts]), packed], ["key", "_rid", "pos", "hashes"])
        c.trim()

    return run


_PIECE = "_rid bigint, start int, n bigint, source bigint, shift int"


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats in a row, from packed rows in the order of anchor, document and position; of the last anchor, the first places go on to the next batch."""
    last, kept = None, [np.zeros(0, np.int64) for _ in range(3)]
    for batch in batches:
        if not batch.num_rows:
            continue
        packed = batch.column("hashes")
        ends = np.frombuffer(packed.buffers()[1], np.int32, len(packed) + 1, packed.offset * 4).astype(np.int64)
        hashes = np.frombuffer(packed.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.int64)
        sizes = np.diff(ends) // 8
        row = np.repeat(np.arange(batch.num_rows), sizes)
        key, rid = c.ints(batch.column("key"))[row], c.ints(batch.column("_rid"))[row]
        pos = c.ints(batch.column("pos")).astype(np.int64)[row] + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        m = len(kept[0]) if last == key[0] else 0
        if m:
            key, hashes, rid, pos = np.append(np.full(m, last), key), np.append(kept[0], hashes), np.append(kept[1], rid), np.append(kept[2], pos)
        order = np.lexsort((hashes, key))  # stable: the earliest place of a stretch comes first
        begins = np.append(True, (np.diff(key[order]) != 0) | (hashes[order][1:] != hashes[order][:-1]))
        firsts = order[begins]
        first = np.empty(len(key), np.int64)
        first[order] = firsts[np.cumsum(begins) - 1]
        last = key[-1]
        ours = firsts[key[firsts] == last]
        kept = [hashes[ours], rid[ours], pos[ours]]
        at = np.nonzero(rid[first] != rid)[0]
        at = at[at >= m]
        if not len(at):
            continue
        source, shift = rid[first[at]], pos[first[at]] - pos[at]
        new = np.append(True, (np.diff(pos[at]) != 1) | (rid[at][1:] != rid[at][:-1]) | (source[1:] != source[:-1]) | (shift[1:] != shift[:-1]))
        starts = np.nonzero(new)[0]
        n = np.diff(np.append(starts, len(at)))
        yield pa.RecordBatch.from_arrays([pa.array(rid[at][starts]), pa.array(pos[at][starts].astype(np.int32)), pa.array(n), pa.array(source[starts]), pa.array(shift[starts].astype(np.int32))], ["_rid", "start", "n", "source", "shift"])
    c.trim()


def repeated_passages(df: DataFrame, min_words: int = MIN_WORDS, key_words: int = KEY_WORDS, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """``(doc_id, start, n_words, source_id, source_start)``: every passage of at least ``min_words`` words that an earlier document has too."""
    spark = df.sparkSession
    _, rows, unique = c.with_row_ids(df, id_col, text_col)
    index = SuffixIndex(spark, min_words, key_words)
    everything = c.stored(index.suffixes(rows).select("key", "_rid", F.pmod(F.xxhash64("_rid"), F.lit(batches)).cast("int").alias("batch")), "suffixes", "batch")
    for k in range(batches):
        index.add(everything.where(F.col("batch") == k).drop("batch"))
    shared = KeyTable(c.stored(index.shared(), "keys"))
    hot_keys = np.sort(np.array([r["key"] for r in index.hot(hot).collect()], np.int64))  # at most one for every ``hot`` suffixes
    known_b = spark.sparkContext.broadcast((shared.table, shared.shift, hot_keys))
    texts = rows.select("_rid", "_text")
    packed = texts.mapInArrow(_stretches(min_words, key_words, known_b, False), "key bigint, _rid bigint, pos int, hashes binary")
    pieces = packed.repartition("key").sortWithinPartitions("key", "_rid", "pos").mapInArrow(_repeats, _PIECE)
    if len(hot_keys):
        stretches = texts.mapInArrow(_stretches(min_words, key_words, known_b, True), "key bigint, _rid bigint, pos int")
        often = stretches.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_rid", "pos")).alias("first"))
        least = c.small(c.stored(often.where(F.col("n") > hot).select("key", "first"), "firsts"), 40)
        firsts = stretches.join(least.select("key"), "key", "left_anti")
        firsts = firsts.select("key", "_rid", "pos", F.min(F.struct("_rid", "pos")).over(Window.partitionBy("key")).alias("first"))
        firsts = firsts.unionByName(stretches.select("key", "_rid", "pos").join(least, "key"))
        single = firsts.where("_rid <> first._rid").select("_rid", F.col("pos").alias("start"), F.lit(1).cast("bigint").alias("n"), F.col("first._rid").alias("source"), (F.col("first.pos") - F.col("pos")).alias("shift"))
        pieces = pieces.unionByName(single)
    # pieces in a row with one source and one shift make a passage
    order = Window.partitionBy("_rid").orderBy("start")
    new = F.when((F.col("start") == F.lag("start").over(order) + F.lag("n").over(order)) & (F.col("source") == F.lag("source").over(order)) & (F.col("shift") == F.lag("shift").over(order)), 0).otherwise(1)
    passages = (
        pieces.withColumn("new", new).withColumn("passage", F.sum("new").over(order))
        .groupBy("_rid", "passage", "source", "shift").agg(F.min("start").alias("start"), (F.sum("n") + min_words - 1).alias("n_words"))
        .select("_rid", "start", "n_words", "source", (F.col("start") + F.col("shift")).alias("source_start"))
    )
    if unique:
        return passages.select(F.col("_rid").alias("doc_id"), "start", "n_words", F.col("source").alias("source_id"), "source_start")
    ids = rows.select("_rid", "_id")
    return (
        passages.join(ids.withColumnRenamed("_id", "doc_id"), "_rid").join(ids.select(F.col("_rid").alias("source"), F.col("_id").alias("source_id")), "source")
        .select("doc_id", "start", "n_words", "source_id", "source_start")
    )
