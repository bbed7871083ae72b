"""What the corpus operators share: scratch tables, row identity, words and hashes.

Everything here is used by more than one operator of this subpackage.  Nothing outside
``millrace.llm`` imports it.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to this many bytes, by its counted rows; beyond it the join shuffles.
BROADCAST_BYTES = 48 << 20
#: Arrow batches are cut to about this many bytes of text before numpy works on them.
SLICE_BYTES = 4 << 20
#: Rows of a scratch table that one reduce task takes.
ROWS_PER_TASK = 2_000_000

_WORD_GAP = r"[^\p{L}\p{N}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent (tests, one machine) a temporary folder is made and set; on a
    cluster its absence is an error, as no machine-local folder would do there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    known = getattr(spark.sparkContext, "_millrace_scratch", None)
    if known is None:
        folder = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        known = "file://" + folder
        spark.sparkContext._millrace_scratch = known
        spark.sparkContext.setCheckpointDir(known)
    return known


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder as Parquet and read them back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its rows, counted now, fit ``BROADCAST_BYTES``; else as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def sized(df: DataFrame, array: str) -> DataFrame:
    """``df`` with a broadcast hint if its rows and the entries of its array column, counted now, fit ``BROADCAST_BYTES``."""
    counted = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(array)).alias("entries")).first()
    return F.broadcast(df) if counted["n"] * 48 + (counted["entries"] or 0) * 32 <= BROADCAST_BYTES else df


def tasks_for(rows: int, per_task: int = ROWS_PER_TASK, least: int = 12) -> int:
    return max(least, -(-rows // per_task))


def with_row_ids(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, bool]:
    """``(all columns + _rid, rows (_rid, _id, _text), whether _rid is the id)``; ``_rid`` tells every row from every other.

    Usually ``_rid`` is the id itself.  Only where ids repeat, are null or are no integers, the table is
    written once with fresh row numbers, which then hold however often it is read again.  They follow the
    order of the ids (null last), and of the texts' hashes and the texts where ids are equal, however the
    table is partitioned; ranges over id and hash split an id that many rows share.  All columns are
    named by their place (``c0``, ``c1`` ...), so that no name can clash; ``restored`` names them as they were.
    """
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    row_id, text = place(df, id_col), place(df, text_col)
    ids = plain.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col(row_id)).alias("d")).first()
    unique = ids["n"] == ids["d"] and dict(plain.dtypes)[row_id] in ("tinyint", "smallint", "int", "bigint")
    if unique:
        tagged = plain.withColumn("_rid", F.col(row_id).cast("bigint"))
    else:
        order = [F.col(row_id).asc_nulls_last(), F.xxhash64(F.col(text)).asc()]
        ranged = plain.repartitionByRange(tasks_for(ids["n"]), *order).sortWithinPartitions(*order, F.col(text).asc_nulls_last())
        tagged = stored(ranged.withColumn("_rid", F.monotonically_increasing_id()), "rows")
    return tagged, tagged.select("_rid", F.col(row_id).alias("_id"), F.col(text).cast("string").alias("_text")), unique


def place(df: DataFrame, name: str) -> str:
    """The name by place of the column ``name`` of ``df``."""
    return f"c{df.columns.index(name)}"


def restored(tagged: DataFrame, df: DataFrame) -> DataFrame:
    """The columns of ``df``, under their names, of what ``with_row_ids`` made of it."""
    return tagged.select(*(f"c{i}" for i in range(len(df.columns)))).toDF(*df.columns)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes in each; one row may exceed it."""
    for batch in batches:
        for a, b in _bounds(batch.column(column), limit):
            yield batch.slice(a, b - a)
    trim()


def cut(texts: pa.Array, limit: int) -> Iterator[pa.Array]:
    """``texts`` in parts of about ``limit`` bytes, as ``slices`` cuts batches."""
    for a, b in _bounds(texts, limit):
        yield texts.slice(a, b - a)


def _bounds(texts: pa.Array, limit: int) -> list[tuple[int, int]]:
    if not len(texts):
        return []
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes.astype(np.int64)) // limit
    starts = np.concatenate([[0], np.nonzero(np.diff(group))[0] + 1, [len(texts)]]).tolist()
    return list(zip(starts[:-1], starts[1:]))


def trim() -> None:
    """Give freed memory back to the system, as Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def ints(array: pa.Array) -> np.ndarray:
    return array.to_numpy(zero_copy_only=False)


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``(codes, offsets, words)``: text i has the words ``words[codes[offsets[i]:offsets[i + 1]]]``.

    A word is a maximal run of letters and digits of the lower-cased text.  Null and empty texts have none.
    """
    plain = pc.utf8_lower(pc.fill_null(texts, ""))
    plain = pc.utf8_trim(pc.replace_substring_regex(plain, pattern=_WORD_GAP, replacement=" "), characters=" ")
    lists = pc.split_pattern(plain, " ")
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    lengths = np.diff(ints(lists.offsets)).astype(np.int64)
    blank = ints(pc.equal(plain, ""))
    if blank.any():
        keep = np.repeat(~blank, lengths)
        codes, lengths = codes[keep], np.where(blank, 0, lengths)
    return codes.astype(np.int64), np.concatenate([[0], np.cumsum(lengths)]), coded.dictionary


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit integers (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Rolling:
    """Hashes of every run of k symbols of a sequence, any k, from one prefix sum modulo 2**64."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        powers = np.full(n + 1, _BASE, np.uint64)
        powers[0] = 1
        self._back = np.full(n + 1, _INVERSE, np.uint64)
        self._back[0] = 1
        np.multiply.accumulate(powers, out=powers)
        np.multiply.accumulate(self._back, out=self._back)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * powers[:n], out=self._sums[1:])
        self.n = n

    def runs(self, k: int) -> np.ndarray:
        """``n - k + 1`` hashes (none if n < k)."""
        m = self.n - k + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        return mix((self._sums[k:] - self._sums[:m]) * self._back[:m])


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def hash_words(words: pa.Array) -> np.ndarray:
    """64-bit hashes of strings from their UTF-8 bytes, the same in every process."""
    words = words.cast(pa.large_binary())
    ends = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    if not len(words):
        return np.zeros(0, np.uint64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    rolling = Rolling(_BYTES[data])
    spans = (rolling._sums[ends[1:]] - rolling._sums[ends[:-1]]) * rolling._back[ends[:-1]]
    return mix(spans + np.diff(ends).astype(np.uint64) * _BASE)
