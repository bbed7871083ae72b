"""Exact deduplication (operator 9): distributed MSD radix partitioning of the documents' bytes.

All documents start in one group.  Each round splits every group by the next bytes of its
documents, most significant first; a group that has become a single document, or whose documents
have all ended, is done.  The digit grows from round to round (64 bytes, then 4 KB, 64 KB, and 1 MB
for as long as anything is left), so that the many documents that differ early leave after one
narrow round and long copies don't need one round a byte.  After the first rounds the rest of the documents
that are still alike is written, so that later rounds don't read the corpus again.  Digits are compared as
bytes; there is no digest.  A group is named by the least row in it, and equal digits of a group meet as one
partial aggregate per task, so thousands of copies of one text make no hot key.

Defined cases: null texts are copies of nothing; empty texts are copies of each other; among equal
texts the row with the least id stays (in the order of ids of any type, null last, one row of those with
the same id); other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common as c

#: Bytes per digit in the first rounds; the last width repeats.
DIGITS = (64, 4096, 65_536, 1 << 20)


def _copies(rows: DataFrame) -> DataFrame:
    """``(_rid, first)`` of the rows ``(_rid, _text)`` whose text equals that of the smaller row ``first``."""
    data = rows.where(F.col("_text").isNotNull()).select("_rid", F.lit(0).cast("bigint").alias("group"), F.col("_text").cast("binary").alias("_bytes"))
    alive, done, start, turn = None, [], 1, 0
    while True:
        width = DIGITS[min(turn, len(DIGITS) - 1)]
        live = data if alive is None else data.drop("group").join(alive, "_rid")
        if 0 < turn < len(DIGITS) - 1:  # most documents leave early: what follows reads only the rest of the others
            data = live = c.stored(live.select("_rid", "group", F.expr(f"substring(_bytes, {start})").alias("_bytes")), "rest")
            start = 1
        digits = live.select("_rid", "group", F.expr(f"substring(_bytes, {start}, {width})").alias("digit"), (F.octet_length("_bytes") < start + width).alias("ended"))
        groups = digits.groupBy("group", "digit", "ended").agg(F.min("_rid").alias("next"), F.count(F.lit(1)).alias("n")).where("n > 1")
        groups = c.stored(groups.drop("n"), "digits")
        split = digits.join(c.small(groups, 2 * width + 64), ["group", "digit", "ended"]).select("_rid", F.col("next").alias("group"), "ended")
        split = c.stored(split, "groups")
        done.append(split.where("ended and _rid <> group").select("_rid", F.col("group").alias("first")))
        going = split.where("not ended").select("_rid", "group")
        if not going.limit(1).count():
            break
        alive = c.small(going, 32)
        start, turn = start + width, turn + 1
    copies = done[0]
    for more in done[1:]:
        copies = copies.unionByName(more)
    return copies


def exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, kept_id)``: every document that repeats the text of another, and the one that stays for it."""
    _, rows, unique = c.with_row_ids(df, id_col, text_col)
    copies = _copies(rows)
    if unique:
        return copies.select(F.col("_rid").alias("doc_id"), F.col("first").alias("kept_id"))
    ids = rows.select("_rid", "_id")
    return (
        copies.join(ids.withColumnRenamed("_id", "doc_id"), "_rid")
        .join(ids.select(F.col("_rid").alias("first"), F.col("_id").alias("kept_id")), "first")
        .select("doc_id", "kept_id")
    )


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the rows that repeat the text of an earlier one."""
    tagged, rows, _ = c.with_row_ids(df, id_col, text_col)
    return c.restored(tagged.join(c.small(c.stored(_copies(rows).select("_rid"), "copies"), 16), "_rid", "left_anti"), df)
