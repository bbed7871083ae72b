"""Best-fit packing (operator 2), planned over the histogram of lengths.

Documents longer than a sequence are cut into full sequences and a rest.  The driver receives one
count per length (at most ``capacity`` rows, whatever the corpus holds) and runs best-fit
decreasing over the counts: all pieces of one length are placed at once, into groups of bins that
are alike.  The outcome is the same as placing the pieces one by one.  Each step of the plan says
which ranks of a length go to which bins, and the pieces take their slots by a join on length and rank.

Ranks within a length are computed per (length, bucket of rows) and shifted by the buckets before,
so that a common length is not ranked in one task.

Defined cases: null texts and texts without words have length 0, as have rows whose given length is null
or negative; they occupy nothing and come out with a null ``bin_id``; equal lengths are ranked by id, then piece; rows that repeat an id are pieces of
their own; other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import common as c

#: Ranks per block of the plan; pieces and plan meet on (length, block).
BLOCK = 4096
#: Rows that are ranked together.
RANKED_TOGETHER = 500_000


def word_length(text: Column) -> Column:
    """Number of words, split at white space; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"\s+"), "")), F.lit(0))


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Steps ``(length, first rank, pieces, first bin, pieces per bin, offset)``: piece number j of a step
    goes to bin ``first bin + j // per``, behind ``offset`` and ``j % per`` other pieces of its length.
    """
    steps: list[tuple[int, int, int, int, int, int]] = []
    open_bins: dict[int, deque[tuple[int, int]]] = {}  # space left -> (first bin, bins), oldest first
    spaces: list[int] = []
    next_bin = 0

    def put(space: int, first: int, bins: int, front: bool = False) -> None:
        if space not in open_bins:
            open_bins[space] = deque()
            insort(spaces, space)
        (open_bins[space].appendleft if front else open_bins[space].append)((first, bins))

    for length in sorted((n for n in histogram if n > 0), reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, bins = open_bins[space].popleft()
                if not open_bins[space]:
                    del open_bins[space], spaces[at]
            else:
                per = capacity // length
                space, first, bins = capacity, next_bin, -(-left // per)
                next_bin += bins
            per = space // length
            full = min(bins, left // per)
            if full:
                steps.append((length, rank, full * per, first, per, capacity - space))
                rank, left = rank + full * per, left - full * per
                if space - per * length:
                    put(space - per * length, first, full)
            rest = bins - full
            if rest:
                at_bin = first + full
                if left and left < per:
                    steps.append((length, rank, left, at_bin, per, capacity - space))
                    if space - left * length:
                        put(space - left * length, at_bin, 1)
                    rank, left, rest, at_bin = rank + left, 0, rest - 1, at_bin + 1
                if rest:
                    put(space, at_bin, rest, front=True)
    return steps


def best_fit_pack(df: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None) -> DataFrame:
    """Pack every document into sequences of ``capacity``; lengths are words unless ``length`` is given.

    Returns ``(doc_id, piece, piece_start, piece_length, bin_id, bin_offset)``, one row per piece.
    """
    spark = df.sparkSession
    n = F.greatest(F.coalesce((word_length(F.col(text_col)) if length is None else length).cast("bigint"), F.lit(0)), F.lit(0))
    lengths = df.select(F.col(id_col).alias("doc_id"), n.alias("n"))
    pieces = c.stored(
        lengths.select("doc_id", "n", F.posexplode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n") - 1) / capacity).cast("int")))).alias("_", "piece"))
        .select("doc_id", "piece", (F.col("piece") * F.lit(capacity).cast("bigint")).alias("piece_start"), F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int").alias("piece_length")),
        "pieces",
    )
    placed = pieces.where("piece_length > 0")
    total = placed.count()
    buckets = max(1, -(-total // RANKED_TOGETHER))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = placed.groupBy("piece_length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["piece_length"]: r["n"] for r in counts.groupBy("piece_length").agg(F.sum("n").alias("n")).collect()}
    steps = plan(histogram, capacity)
    before = counts.select("piece_length", "bucket", (F.sum("n").over(Window.partitionBy("piece_length").orderBy("bucket")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("piece_length", "bucket").orderBy("doc_id", "piece")) - 1
    ranked = (
        placed.withColumn("within", within)
        .join(c.small(before, 32), ["piece_length", "bucket"])
        .select("doc_id", "piece", "piece_start", "piece_length", (F.col("before") + F.col("within")).alias("rank"))
        .withColumn("block", F.floor(F.col("rank") / BLOCK))
    )
    columns = list(zip(*steps)) or [()] * 6
    kinds = {"piece_length": pa.int32(), "first": pa.int64(), "pieces": pa.int64(), "first_bin": pa.int64(), "per": pa.int32(), "offset": pa.int32()}
    slots = spark.createDataFrame(pa.table({k: pa.array(x, kind) for (k, kind), x in zip(kinds.items(), columns)}))  # of a list, Python workers would start
    slots = slots.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("first") + F.col("pieces") - 1) / BLOCK))))
    step = F.col("rank") - F.col("first")
    packed = (
        ranked.join(c.small(slots, 64), ["piece_length", "block"])
        .where((step >= 0) & (step < F.col("pieces")))
        .select(
            "doc_id", "piece", "piece_start", "piece_length",
            (F.col("first_bin") + F.floor(step / F.col("per"))).alias("bin_id"),
            (F.col("offset") + (step % F.col("per")) * F.col("piece_length")).cast("int").alias("bin_offset"),
        )
    )
    empty = pieces.where("piece_length = 0").select("doc_id", "piece", "piece_start", "piece_length", F.lit(None).cast("bigint").alias("bin_id"), F.lit(None).cast("int").alias("bin_offset"))
    return packed.unionByName(empty)
