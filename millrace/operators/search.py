"""Exact vector search, keyword scores, hybrid and federated ranking.

Queries come as a DataFrame and are answered all at once.  Every ranking has a total order, so that
results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.text import strip, tokens
from millrace.functions.vectors import clamp01

K1, B, RRF_K = 1.5, 0.75, 60
BLOCK_ROWS = 2048
#: Queries go to every task up to this size; of more, each task takes a group against a segment of the store.
BROADCAST_BYTES = 4 << 20
#: Queries of a group; tasks that a search is cut into where groups alone are fewer, and pairs that are worth a task.
GROUP_ROWS, TASKS, TASK_PAIRS = 32_768, 72, 200_000_000
#: Queries that meet a block at once, pairs that are multiplied in double precision at once, and queries of a batch of results.
TILE_ROWS, CANDIDATES, OUT_ROWS = 512, 16_384, 8_192
#: Queries whose candidates' words are counted at once; groups of queries where it isn't said how many there are.
QUERIES_AT_ONCE, MANY_BUCKETS = 64, 4_096
DIGITS = 9


def _blocks(kind: str, dtype: str):
    """Blocks of vectors of one length and one part: part, ids, length, matrix.  A null entry counts as 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            parts = batch.column("part").to_numpy(zero_copy_only=False)
            order = np.lexsort((lengths, parts))
            cuts = np.nonzero((np.diff(lengths[order]) != 0) | (np.diff(parts[order]) != 0))[0] + 1
            for at in np.split(order, cuts):
                width, part = int(lengths[at[0]]), int(parts[at[0]])
                for low in range(0, len(at), BLOCK_ROWS):
                    mine = batch.take(pa.array(at[low : low + BLOCK_ROWS]))
                    flat = pc.fill_null(mine.column("v").flatten(), 0.0).to_numpy(zero_copy_only=False).astype(dtype)
                    ids = pa.ListArray.from_arrays(pa.array([0, mine.num_rows], pa.int32()), mine.column("id"))
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), ids, pa.array([width], pa.int32()), pa.array([flat.tobytes()])], ["part", "ids", "width", "data"])

    return run, f"part int, ids array<{kind}>, width int, data binary"


def _units(data: pa.Scalar, dtype: str, rows: int, width: int) -> np.ndarray:
    """The block's vectors in double precision, each divided by its length; the zero vector stays.  Sums go from left to right, as in SQL."""
    v = np.frombuffer(data.as_buffer(), dtype).reshape(rows, width).astype(np.float64)
    norms = np.sqrt(_sums(v * v))[:, None]
    return np.divide(v, norms, out=v, where=norms != 0)


def _sums(products: np.ndarray) -> np.ndarray:
    return np.cumsum(products, axis=1)[:, -1] if products.shape[1] else np.zeros(len(products))


def _round(x: np.ndarray) -> np.ndarray:
    """To DIGITS digits, half away from zero."""
    x = x * 10.0**DIGITS
    whole = np.trunc(x)
    return (whole + np.where(np.abs(x - whole) >= 0.5, np.sign(x), 0.0)) / 10.0**DIGITS


class _Best:
    """The k best store rows so far of some queries of one length.

    Single-precision products leave out what is below the k-th best score by more than their error; what remains is
    multiplied in double precision.  NaN counts as the greatest score, as it does in an ORDER BY, and is held as infinity.
    """

    def __init__(self, ids: pa.Array, vectors: np.ndarray, k: int) -> None:
        self.ids, self.q, self.low, self.k = ids, vectors, vectors.astype(np.float32), k
        self.scores = np.full((len(vectors), k), -np.inf)
        self.found: np.ndarray | None = None
        self.rough, self.near = np.empty(0, np.float32), np.empty(0, bool)  # kept, as fresh pages cost as much as the products

    def meet(self, ids: np.ndarray, s: np.ndarray, low: np.ndarray) -> None:
        if self.found is None:
            self.found = np.empty(self.scores.shape, ids.dtype)
        if len(self.rough) < TILE_ROWS * len(s):
            self.rough, self.near = np.empty(TILE_ROWS * len(s), np.float32), np.empty(TILE_ROWS * len(s), bool)
        common = min(self.q.shape[1], s.shape[1])
        error = (common + 8) * 2.0**-23
        for a in range(0, len(self.q), TILE_ROWS):
            tile = self.low[a : a + TILE_ROWS, :common]
            rough = np.matmul(tile, low[:, :common].T, out=self.rough[: len(tile) * len(s)].reshape(len(tile), len(s)))
            near = np.less(rough, (self.scores[a : a + TILE_ROWS, -1] - error).astype(np.float32)[:, None], out=self.near[: rough.size].reshape(rough.shape))
            np.logical_not(near, out=near)
            if len(s) > self.k and np.count_nonzero(near) > 4 * self.k * len(rough):
                kth = np.partition(rough, len(s) - self.k, axis=1)[:, len(s) - self.k]
                near &= ~(rough < (kth - np.float32(2 * error))[:, None])
            at = np.flatnonzero(near)
            for i in range(0, len(at), CANDIDATES):
                rows, cols = np.divmod(at[i : i + CANDIDATES], len(s))
                rows += a
                scores = _round(_sums(self.q[rows, :common] * s[cols, :common]))
                self._take(rows, np.where(np.isnan(scores), np.inf, scores), ids[cols])

    def _take(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        last = self.scores[rows, -1]
        better = scores > last
        level = np.nonzero(scores == last)[0]
        better[level] = ids[level] < self.found[rows[level], -1]
        if not better.any():
            return
        rows, scores, ids = rows[better], scores[better], ids[better]
        mine = np.unique(rows)
        rows = np.concatenate([rows, np.repeat(mine, self.k)])
        scores = np.concatenate([scores, self.scores[mine].ravel()])
        ids = np.concatenate([ids, self.found[mine].ravel()])
        there = scores > -np.inf
        rows, scores, ids = rows[there], scores[there], ids[there]
        order = np.lexsort((ids if ids.dtype.kind in "iufM" else np.unique(ids, return_inverse=True)[1], -scores, rows))
        rows = rows[order]
        first = np.searchsorted(rows, rows)
        place = np.arange(len(rows)) - first
        kept = place < self.k
        rows, place, order = rows[kept], place[kept], order[kept]
        self.scores[rows, place], self.found[rows, place] = scores[order], ids[order]

    def rows(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(self.q) if self.found is not None else 0, OUT_ROWS):
            there = self.scores[low : low + OUT_ROWS] > -np.inf
            scores, found = self.scores[low : low + OUT_ROWS][there], self.found[low : low + OUT_ROWS][there]
            row = pa.array(low + np.nonzero(there)[0])
            yield pa.RecordBatch.from_arrays([self.ids.take(row), pa.array(found, kind), pa.array(np.where(np.isinf(scores), np.nan, scores))], ["query_id", "chunk_id", "score"])


def _asked(blocks: list[tuple[pa.Array, np.ndarray]], k: int) -> list[_Best]:
    widths: dict[int, list] = {}
    for block in blocks:
        widths.setdefault(block[1].shape[1], []).append(block)
    return [_Best(*_joined(own), k) for own in widths.values()]


def _joined(blocks: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
    return pa.concat_arrays([ids for ids, _ in blocks]), np.vstack([v for _, v in blocks])


def _block(batch: pa.RecordBatch, i: int, side: str, dtype: str) -> tuple[pa.Array, np.ndarray]:
    ids, width, data = (batch.column(f"{side}_{x}")[i] for x in ("ids", "width", "data"))
    return ids.values, _units(data, dtype, len(ids.values), width.as_py())


def _meet(best: list[_Best], block: tuple[pa.Array, np.ndarray]) -> None:
    ids, low = block[0].to_numpy(zero_copy_only=False), block[1].astype(np.float32)
    for b in best:
        b.meet(ids, block[1], low)


def _scan(k: int, q_type: str, s_type: str):
    """A task's store blocks, each beside every block of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[_Best]] = {}
        kind = None
        for batch in batches:
            kind = batch.column("s_ids").type.value_type
            for i, no in enumerate(batch.column("q_no").to_pylist()):
                if no not in best:
                    best[no] = _asked([_block(batch, i, "q", q_type)], k)
                _meet(best[no], _block(batch, i, "s", s_type))
        for b in best.values():
            yield from b[0].rows(kind)

    return run


def _grid_scan(k: int, q_type: str, s_type: str):
    """Of each part query blocks, then store blocks, of which as many are held at once as make a full one."""

    def found(blocks: Iterator[tuple[bool, tuple[pa.Array, np.ndarray]]]) -> list[_Best]:
        asked, best, held = [], [], {}
        for is_store, block in blocks:
            if not is_store:
                asked.append(block)
                continue
            if asked:
                best, asked = _asked(asked, k), []
            own = held.setdefault(block[1].shape[1], [])
            own.append(block)
            if sum(len(ids) for ids, _ in own) >= BLOCK_ROWS:
                _meet(best, _joined(held.pop(block[1].shape[1])))
        for own in held.values():
            _meet(best, _joined(own))
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def rows() -> Iterator[tuple]:
            nonlocal kind
            for batch in batches:
                kind = batch.column("s_ids").type.value_type
                for i, (part, is_store) in enumerate(zip(batch.column("part").to_pylist(), pc.is_null(batch.column("q_ids")).to_pylist())):
                    yield part, is_store, _block(batch, i, "s" if is_store else "q", s_type if is_store else q_type)

        for _, own in groupby(rows(), key=lambda r: r[0]):
            for b in found((is_store, block) for _, is_store, block in own):
                yield from b.rows(kind)

    return run


def _id(rows: DataFrame, name: str) -> Column:
    return F.col(name).cast("bigint") if rows.schema[name].dataType.typeName() in ("byte", "short", "integer") else F.col(name)


def vector_search(store: DataFrame, queries: DataFrame, k: int = 5, where: Column | None = None) -> DataFrame:
    """The ``k`` store vectors with the highest cosine for every query: ``(query_id, rank, chunk_id, score)``.

    ``store (chunk_id, embedding, ...)`` is filtered by ``where`` before scoring.  Both sides are cut into
    blocks.  A task holds a group of queries with the k best so far of each, and store blocks pass by one at a time;
    a window ranks what the tasks found.  So memory does not grow with the input, what is shuffled is the store once
    per group, and only the products are quadratic.  Scores are rounded to 9 digits and ties go to the smaller id.

    Ids are of any type that has an order.  Vectors of different lengths are multiplied over their common length,
    each divided by its own norm; a null entry counts as 0; rows without id or vector are not searched.
    """
    if where is not None:
        store = store.where(where)
    sides = []
    for rows, name in ((store, "chunk_id"), (queries, "query_id")):
        there = rows.where(F.col("embedding").isNotNull() & F.col(name).isNotNull())
        single = rows.schema["embedding"].dataType.elementType.typeName() == "float"
        sides.append((there.select(_id(rows, name).alias("id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("v")), "<f4" if single else "<f8"))
    (s, s_type), (q, q_type) = sides
    s_kind, q_kind = (x.schema["id"].dataType.simpleString() for x in (s, q))
    blocks = lambda rows, parts, side, kind, dtype: (
        rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part")).mapInArrow(*_blocks(kind, dtype)).toDF("part", *(f"{side}_{x}" for x in ("ids", "width", "data")))
    )
    asked = q.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("v") * 8 + 64).alias("bytes")).first()
    out = f"query_id {q_kind}, chunk_id {s_kind}, score double"
    if (asked["bytes"] or 0) <= BROADCAST_BYTES:
        qb = blocks(q, 1, "q", q_kind, q_type).drop("part").withColumn("q_no", F.monotonically_increasing_id())
        found = blocks(s, 1, "s", s_kind, s_type).drop("part").crossJoin(F.broadcast(qb)).mapInArrow(_scan(max(k, 1), q_type, s_type), out)
    else:
        groups, segments = _grid(asked["n"], s.count())
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("to")
        qb = blocks(q, groups, "q", q_kind, q_type).select("*", each(segments)).withColumn("part", (F.col("part") * segments + F.col("to")).cast("int"))
        sb = blocks(s, segments, "s", s_kind, s_type).select("*", each(groups)).withColumn("part", (F.col("to") * segments + F.col("part")).cast("int"))
        met = qb.unionByName(sb, allowMissingColumns=True).drop("to").repartitionById(groups * segments, F.col("part")).sortWithinPartitions("part", F.col("q_ids").isNull())
        found = met.mapInArrow(_grid_scan(max(k, 1), q_type, s_type), out)
    return top_k(found, k, F.desc("score"), F.col("chunk_id")).select("query_id", "rank", "chunk_id", "score")


def _grid(asked: int, stored: int) -> tuple[int, int]:
    """Groups of queries and segments of the store, each of which meets each in one task."""
    groups = max(1, -(-asked // GROUP_ROWS))
    tasks = min(TASKS, -(-stored * asked // TASK_PAIRS))
    return groups, max(1, -(-tasks // groups))


def top_k(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """Rows with the first ``k`` ranks per query."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def metadata_filter(**wanted) -> Column:
    """All keys equal the wanted values; a key that is missing or null does not."""
    out = F.lit(True)
    for key, value in wanted.items():
        out = out & F.coalesce(F.col(key) == F.lit(value), F.lit(False))
    return out


def term_text(text: Column) -> Column:
    """The tokens of ``text`` in one string: a tenth of what an array of them takes in a shuffle."""
    return F.array_join(tokens(text), " ")


def _termed(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``terms``, which may have been made before the rows were multiplied."""
    return rows if "terms" in rows.columns else rows.withColumn("terms", term_text(F.col(text)))


def _by_query(rows: DataFrame, queries: DataFrame | None, run, schema: str) -> DataFrame:
    """``run`` over Arrow tables of all rows of about QUERIES_AT_ONCE queries each: rows are shuffled once, and a task holds one table at a time."""
    buckets = MANY_BUCKETS if queries is None else max(1, queries.count() // QUERIES_AT_ONCE)
    return rows.withColumn("_bucket", F.pmod(F.xxhash64("query_id"), F.lit(buckets)).cast("int")).groupBy("_bucket").applyInArrow(run, schema)


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _split_terms(terms: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``(rows, codes, words)``: a token in row ``rows[i]`` is ``words[codes[i]]``."""
    lists = pc.split_pattern(pc.fill_null(terms.combine_chunks(), ""), " ")
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    there = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0, bool)
    return row[there], codes[there], coded.dictionary


def document_frequency(candidates: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """In how many of a query's candidates ``(query_id, chunk_id, content)`` each term is; ``queries`` tell how many there are."""
    rows = _termed(candidates, "content").select("query_id", "chunk_id", "terms")

    def run(table: pa.Table) -> pa.Table:
        asked, ids = _coded(table.column("query_id"))
        chunk, chunks = _coded(table.column("chunk_id"))
        row, code, words = _split_terms(table.column("terms"))
        _, pair = np.unique(asked * len(chunks) + chunk, return_inverse=True)  # a chunk counts once
        of_pair = np.empty(len(asked), np.int64)
        of_pair[pair] = asked
        seen = np.unique(pair[row] * len(words) + code)
        found, n = np.unique(of_pair[seen // max(1, len(words))] * len(words) + seen % max(1, len(words)), return_counts=True)
        return pa.table({"query_id": ids.take(pa.array(found // max(1, len(words)))), "term": words.take(pa.array(found % max(1, len(words)))), "df": pa.array(n, pa.int64())})

    return _by_query(rows, queries, run, f"query_id {rows.schema['query_id'].dataType.simpleString()}, term string, df bigint")


def average_length(candidates: DataFrame) -> DataFrame:
    """Mean number of tokens of a query's candidates, of which ``length`` may have been counted before."""
    length = F.col("length") if "length" in candidates.columns else F.size(tokens(F.col("content")))
    return candidates.groupBy("query_id").agg(F.avg(length).alias("avg_length"))


def _with_bm25(candidates: DataFrame, queries: DataFrame, k1: float, b: float, *keep: str) -> DataFrame:
    """``(query_id, chunk_id, *keep, bm25)``; the candidates are read once, and meet the query's own words in one shuffle."""
    rows = _termed(candidates, "content").select("query_id", "chunk_id", *keep, "terms", F.lit(False).alias("_asks"))
    asked = _termed(queries, "query").select("query_id", "terms", F.lit(True).alias("_asks"))
    out = ["query_id", "chunk_id", *keep]

    def run(table: pa.Table) -> pa.Table:
        query, ids = _coded(table.column("query_id"))
        asks = table.column("_asks").to_numpy()
        row, code, words = _split_terms(table.column("terms"))
        length = np.bincount(row, minlength=len(query))
        known = table.column("terms").is_valid().to_numpy() & ~asks
        count = np.bincount(query[~asks], minlength=len(ids))
        mean = np.bincount(query[known], length[known], len(ids)) / np.maximum(1, np.bincount(query[known], minlength=len(ids)))
        size = np.zeros(len(ids), np.int64)
        np.maximum.at(size, query[asks], length[asks])
        cell, times = np.unique(row * len(words) + code, return_counts=True)
        row, term = cell // max(1, len(words)), cell % max(1, len(words))
        place, mine = query[row] * len(words) + term, asks[row]
        wanted, at = np.unique(place[mine], return_inverse=True)
        repeats = np.bincount(at, times[mine], len(wanted))
        row, place, f = row[~mine], place[~mine], times[~mine]
        _, at, df = np.unique(place, return_inverse=True, return_counts=True)
        df = df[at]
        at = np.minimum(np.searchsorted(wanted, place), max(0, len(wanted) - 1))
        hit = wanted[at] == place if len(wanted) else np.zeros(len(place), bool)
        row, f, df, repeats = row[hit], f[hit], df[hit], repeats[at[hit]]
        own = query[row]
        idf = np.log((count[own] - df + 0.5) / (df + 0.5) + 1)
        part = repeats * idf * f * (k1 + 1) / (f + k1 * (1 - b + b * length[row] / mean[own]))
        raw = np.bincount(row, part, len(query))
        best = size[query] * np.log(count[query] + 1.0) * (k1 + 1)
        score = np.divide(np.minimum(raw, best), best, out=np.zeros(len(query)), where=best > 0)
        told = table.select(out).append_column("bm25", pa.array(score))
        return told.filter(pa.array(~asks))

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in out) + ", bm25 double"
    return _by_query(rows.unionByName(asked, allowMissingColumns=True), queries, run, schema)


def bm25(candidates: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """``(query_id, chunk_id, bm25)``: keyword score in [0, 1] with the statistics of the query's candidates.

    ``candidates (query_id, chunk_id, content)``, ``queries (query_id, query)``.  A term that a query repeats
    counts as often; without a common term the score is 0.
    """
    return _with_bm25(candidates, queries, k1, b)


def hybrid_rank(candidates: DataFrame, queries: DataFrame, k: int = 5, semantic: float = 0.7, keyword: float = 0.3) -> DataFrame:
    """Re-rank ``candidates (query_id, rank, chunk_id, score, content)`` by the weighted sum of both scores.

    ``(query_id, rank, chunk_id, score)``; ties keep the candidates' order.  ``k`` of 0 means 5.
    """
    scored = _with_bm25(candidates.withColumnRenamed("rank", "before"), queries, K1, B, "before", "score")
    score = F.round(F.lit(semantic) * clamp01(F.col("score")) + F.lit(keyword) * F.col("bm25"), 6)
    return top_k(scored.withColumn("score", score), k or 5, F.desc("score"), F.col("before")).select("query_id", "rank", "chunk_id", "score")


def method_weights(method: str, semantic: float = 0.7, keyword: float = 0.3) -> tuple[float, float]:
    return {"semantic": (1.0, 0.0), "keyword": (0.0, 1.0), "hybrid": (semantic, keyword)}[method]


def rrf_fuse(sources: list[DataFrame], weights: list[float] | None = None, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of rankings ``(query_id, rank, chunk_id, content)``: ``(query_id, chunk_id, content, first_source, score)``."""
    rows = None
    for i, source in enumerate(sources):
        weight = 1.0 if weights is None or i >= len(weights) else float(weights[i])
        part = source.select("query_id", "chunk_id", "content", F.lit(i).alias("source_no"), "rank", (F.lit(weight) / (F.lit(k) + F.col("rank"))).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    seen = F.struct("source_no", "rank")
    return rows.groupBy("query_id", "chunk_id").agg(
        F.min_by("content", seen).alias("content"), F.min("source_no").alias("first_source"), F.min(seen).alias("seen"), F.round(F.sum("part"), 12).alias("score")
    )


def same_content() -> Column:
    """Stands for a content where only equality counts: whole texts would travel once per result."""
    return F.sha2(strip(F.col("content")), 256)


def rrf_dedup(fused: DataFrame) -> DataFrame:
    """Of rows with the same stripped content, the best-scored; of equals the one seen first."""
    same = Window.partitionBy("query_id", strip(F.col("content"))).orderBy(F.desc("score"), "seen", "chunk_id")
    return fused.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")


def federated_search(stores: list[DataFrame], queries: DataFrame, k: int = 5, weights: list[float] | None = None, dedup: bool = True) -> DataFrame:
    """Search each store for 2k, fuse, drop repeated contents, keep k: ``(query_id, rank, chunk_id, score)``."""
    ranked = [vector_search(s, queries, 2 * k).join(s.select("chunk_id", same_content().alias("content")), "chunk_id") for s in stores]
    fused = rrf_fuse(ranked, weights)
    if dedup:
        fused = rrf_dedup(fused)
    return top_k(fused, k, F.desc("score"), F.col("chunk_id")).select("query_id", "rank", "chunk_id", "score")


def merge_variants(rows: DataFrame, k: int = 5) -> DataFrame:
    """``rows (query_id, variant, chunk_id, score)``: each chunk keeps the score of its first variant, then the best k."""
    first = Window.partitionBy("query_id", "chunk_id").orderBy("variant")
    kept = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return top_k(kept, k, F.desc("score"), F.col("variant"), F.col("chunk_id")).select("query_id", "rank", "chunk_id", "score")
