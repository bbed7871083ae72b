"""N-gram Jaccard join (operator 6): an exact metric-space self-join of documents.

The space is that of word n-gram sets under the Jaccard distance d = 1 - J, which is a metric; r = 1 - theta.
Documents with equal sets are one point.  The join works on two levels of pivots.

Document pivots split the points into Voronoi cells.  Points that share two of three min-hashes meet, the
commonest of them is a pivot, each point goes to its nearest pivot within r, and each cell is centred once
more on the member nearest to its pivot, which of a family of near copies is closest to their common origin.
Distances to the centre are exact.  By the triangle inequality two points of a cell with d(x, p) + d(y, p) <= r
are near: they are counted from the distances alone, and no pair of them is ever made.

Large clusters of which much lies beyond r of every pivot would make pairs with the square of their size.  Around
the centres of the largest cells wider families are drawn, of all points found within 1 - FAMILY_THETA; inside a
family all pairs are compared as products of matrices, block by block, and a block returns one row per document:
how many it is linked to, and one link that leads to the block's component.  Families only decide where a pair is
compared: a point that none takes in is left to its cell and the regions.

All other pairs, between cells and beyond that window, are found in regions of finer pivots, the single grams:

* A global order of the grams, by the corpus count of their rarest word and then by hash, breaks the ties
  between the pivots {g}; grams that a sample of one document in HOT_SAMPLE holds more than once come last, by that
  count, as the count of words says little of that of grams in a large corpus.  Any order is exact.  So the Voronoi region of g holds the sets whose first gram is g.
* By the triangle inequality a set A can have a partner within r only in regions that A reaches by giving up
  its first i grams, which moves it by d = i / |A|: while that is at most r, A is replicated to the region of
  its (i + 1)-th gram.  Two sets within r share a gram in both windows, hence a region.
* Inside a region the join recurses on the cells of the document pivots: cells are ordered by their least
  set, a point meets only the cells that its size allows (d >= 1 - |A| / |B|), and within its own cell only
  the points outside of the window d(x, p) + d(y, p) <= r.
* A pair is then followed through all regions it shares: up to the nearer end of the two windows both sets
  are known, so that overlap <= regions met in + the larger rest behind its window, and a pair that meets in
  fewer regions than this needs is out of reach.  Tasks keep back pairs that met in few of their own regions,
  which is allowed for; the pairs left are compared gram by gram, a large family in blocks.

Document pivots alone do not do: unrelated documents are at distance 1 from each other and from every pivot,
so that windows around them replicate every document to every cell (``window_share`` measures this).

Grams are told apart by 48-bit hashes, in the regions by 41 bits; equal sets by size and two 64-bit sums.

Defined cases: texts that are null or have no word have no grams and no partner, and are classes of their own;
a text with fewer than n words has one gram, all of it; ids that repeat or are null are told apart by row;
other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common as c

#: Places in the table of word counts that orders the grams, as a power of 2.
PLACE_BITS = 22
#: Entries of the region table that one task takes; candidate pairs, and documents in such, that one verification task takes.
ENTRIES_PER_TASK, PAIRS_PER_TASK, SETS_PER_TASK = 2_000_000, 200_000, 4_000
#: Distances to a cell's centre are rounded up to this part of 1, which keeps the counts per cell few and all that follows from them true.
DISTANCE_STEPS = 10_000
_SHARDS, _HASH_BITS = 16, 41
MARGIN = 0.06
#: Bytes of text whose grams are made at once, as the arrays of a slice are many times its text.
GRAM_BYTES = 1 << 20
#: Meetings that a task holds before it counts them by pair; at four times as many pairs it passes them on, PASSED_PAIRS at once.
HELD_PAIRS, PASSED_PAIRS = 1_000_000, 200_000
#: Families are drawn around the largest cells, FAMILIES at most, of FAMILY_LEAST members or more; what is nearer to a centre than this similarity enters.
FAMILIES, FAMILY_LEAST, FAMILY_THETA = 128, 64, 0.2
#: Documents and grams of a strip of a family; a block compares two strips.
STRIP_SETS, STRIP_GRAMS = 2_000, 1_000_000
#: One document in HOT_SAMPLE tells which grams are common; of those that it holds more than once, the commonest HOT_MOST or fewer are put last.
HOT_SAMPLE, HOT_MOST = 8, 2_000_000
#: Of as many hot grams as HOT_MOST, a sieve of so many places lets one gram in eight through to the search; a smaller one fills up as they grow with the corpus.
_SIEVE = np.uint64((1 << 24) - 1)
_CODEC = pa.Codec("zstd", 3)


def gram_keys(texts: pa.Array, n: int, levels: np.ndarray | None = None, hot: tuple[np.ndarray, ...] | None = None) -> Iterator[np.ndarray]:
    """Each text's distinct n-gram hashes of 48 bits, sorted; with ``levels``, by how common the gram's rarest word is first, ``hot`` grams (hashes, levels and, made once for many calls, their ``sieved``) last."""
    sieve = None if hot is None else hot[2] if len(hot) > 2 else sieved(hot[0])
    for part in c.cut(texts, GRAM_BYTES):
        yield from _part_keys(part, n, levels, hot, sieve)


def sieved(grams: np.ndarray) -> np.ndarray:
    """Which places of the sieve the grams take; a gram whose place is free is none of them."""
    sieve = np.zeros(int(_SIEVE) + 1, bool)
    sieve[grams & _SIEVE] = True
    return sieve


def _part_keys(texts: pa.Array, n: int, levels: np.ndarray | None, hot: tuple[np.ndarray, ...] | None, sieve: np.ndarray | None) -> Iterator[np.ndarray]:
    codes, offsets, words = c.split_words(texts)
    hashes = c.hash_words(words)
    symbols = hashes[codes]
    common = None if levels is None else levels[_place(hashes)][codes]

    def keyed(part: slice, k: int) -> np.ndarray:
        grams = c.Rolling(symbols[part]).runs(k)
        if common is None:
            return grams >> np.uint64(16)
        w = common[part]
        rarest = w[: len(grams)].copy()
        for i in range(1, k):
            rarest = np.minimum(rarest, w[i : i + len(grams)])
        grams >>= np.uint64(64 - _HASH_BITS)
        if hot is not None and len(hot[0]):
            maybe = np.nonzero(sieve[grams & _SIEVE])[0]
            at = np.minimum(np.searchsorted(hot[0], grams[maybe]), len(hot[0]) - 1)
            known = hot[0][at] == grams[maybe]
            rarest[maybe[known]] = hot[1][at[known]]
        return (rarest.astype(np.uint64) << np.uint64(_HASH_BITS)) | grams

    keys = keyed(slice(None), n)
    del codes, words, hashes
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= n:
            yield np.unique(keys[a : b - n + 1])
        elif b > a:
            yield keyed(slice(a, b), b - a)
        else:
            yield np.zeros(0, np.uint64)


def _place(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - PLACE_BITS)).astype(np.int64)


def _three_orders(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The grams by the three hashes whose least are the min-hashes."""
    mixed = c.mix(grams ^ c._BASE)
    return grams, mixed, (grams * c._BASE) ^ (mixed >> np.uint64(7))


_SUMMARY = "_rid bigint, size int, s1 bigint, s2 bigint, m1 bigint, m2 bigint, m3 bigint"


def _summaries(n: int):
    """Per text its id, set size, two sums over the grams that identify the set, and three min-hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.slices(batches, "_text"):
            out = np.zeros((6, batch.num_rows), np.int64)
            for i, grams in enumerate(gram_keys(batch.column("_text"), n)):
                if len(grams):
                    grams, mixed, third = _three_orders(grams)
                    out[:, i] = len(grams), *(int(x.view(np.int64)) for x in (grams.sum(dtype=np.uint64), mixed.sum(dtype=np.uint64), grams[0], mixed.min(), third.min()))
            yield pa.RecordBatch.from_arrays([batch.column("_rid"), pa.array(out[0].astype(np.int32)), *map(pa.array, out[1:])], ["_rid", "size", "s1", "s2", "m1", "m2", "m3"])

    return run


_COUNTS = "part int, places binary, counts binary"


def _counted(parts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for part, total in parts.items():
        at = np.nonzero(total)[0]
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at.astype("<u4").tobytes()]), pa.array([total[at].astype("<u8").tobytes()])], ["part", "places", "counts"])


def _place_counts(groups: int):
    """The words of a task counted by place, in shards, for one of ``groups`` groups of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << PLACE_BITS, np.uint32)
        for batch in c.slices(batches, "_text", GRAM_BYTES):
            codes, _, words = c.split_words(batch.column("_text"))
            np.add.at(total, _place(c.hash_words(words)), np.bincount(codes, minlength=len(words)).astype(np.uint32))
        group = TaskContext.get().partitionId() % groups
        yield from _counted({shard * groups + group: part for shard, part in enumerate(np.split(total, _SHARDS))})

    return run


def _place_totals(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
    """Sum the counts of each part, one task's at a time."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, at, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
            total = totals.setdefault(part, np.zeros((1 << PLACE_BITS) // _SHARDS, np.uint64))
            total[np.frombuffer(at, "<u4")] += np.frombuffer(counts, "<u8")
    return totals


def _place_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _counted(_place_totals(batches))


def word_levels(rows: DataFrame) -> np.ndarray:
    """How common words are in the corpus, by place of their hash: 0 for a count of 1, then two levels for every doubling.

    Words that share a place count together.  The table has 2**PLACE_BITS bytes whatever the corpus holds; it
    only orders the grams.  Tasks are summed in groups, about as many as the square root of their number, then all.
    """
    groups = max(1, math.isqrt(rows.rdd.getNumPartitions()))
    counts = rows.select("_text").mapInArrow(_place_counts(groups), _COUNTS)
    sums = counts.repartitionById(_SHARDS * groups, F.col("part")).mapInArrow(_place_sums, _COUNTS)
    sums = sums.withColumn("part", F.floor(F.col("part") / groups).cast("int")).repartitionById(_SHARDS, F.col("part"))
    levels = np.zeros((_SHARDS, (1 << PLACE_BITS) // _SHARDS), np.uint8)
    for r in sums.mapInArrow(_place_levels, "part int, levels binary").collect():
        levels[r["part"]] = np.frombuffer(r["levels"], np.uint8)
    return levels.ravel()


def _place_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The levels of each part, summed here too: a task of two Python steps would take two workers, and each executor would keep twice as many."""
    for part, total in _place_totals(batches).items():
        at = np.nonzero(total)[0]
        if len(at):
            levels = np.zeros((1 << PLACE_BITS) // _SHARDS, np.uint8)
            levels[at] = np.minimum(np.round(2 * np.log2(total[at].astype(np.float64))), 63)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([levels.tobytes()])], ["part", "levels"])


_ENTRY = np.dtype([("low", "<u4"), ("high", "<u2"), ("ref", "<u2")])
_HEAD = np.dtype([("rid", "<i8"), ("cell", "<i8"), ("size", "<u4"), ("far", "<u2")])


def within_reach(theta: float) -> int:
    """The greatest sum of two distances to a centre, in steps, that makes the pair near."""
    return math.floor((1 - theta) * DISTANCE_STEPS + 1e-6)


def window_size(size, theta: float):
    """How many regions a set of ``size`` grams reaches within distance 1 - theta, and a margin of MARGIN * size more.

    Thanks to the margin every near pair meets in at least MARGIN * size regions, so that a few chance meetings make no candidate.
    """
    return np.minimum(np.floor((1 - theta + MARGIN) * size + 1e-9).astype(np.int64) + 1, np.asarray(size, np.int64))


def _keys(entries: np.ndarray) -> np.ndarray:
    return (entries["high"].astype(np.uint64) << np.uint64(32)) | entries["low"]


def _gram_counts(levels_b, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.slices(batches, "_text"):
            grams = [g[: int(0.7 * len(g)) + 1] for g in gram_keys(batch.column("_text"), n, levels_b.value)]  # those behind are in no window
            flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
            found, counts = np.unique(flat[flat >> np.uint64(_HASH_BITS) > 0] & np.uint64((1 << _HASH_BITS) - 1), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts)], ["gram", "n"])

    return run


def hot_grams(rows: DataFrame, levels_b, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 41-bit hashes of the grams that are common among the sampled documents, and their levels: from 64 on, two for every doubling."""
    some = rows.where(F.pmod(F.xxhash64("_rid", F.lit(6)), F.lit(HOT_SAMPLE)) == 0)
    counts = some.select("_text").mapInArrow(_gram_counts(levels_b, n), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1")
    counts = c.stored(counts, "hot")
    least, kept = 2, 0
    for r in counts.groupBy(F.least("n", F.lit(4096)).alias("n")).count().orderBy(F.desc("n")).collect():
        kept += r["count"]
        if kept > HOT_MOST:
            least = r["n"] + 1
            break
    found = counts.where(F.col("n") >= least).toArrow()
    grams, times = (c.ints(found.column(x).combine_chunks()) for x in ("gram", "n"))
    order = np.argsort(grams)
    return grams[order].astype(np.uint64), np.minimum(64 + np.round(2 * np.log2(times[order])), 127).astype(np.uint8)


def _windows(levels_b, hot_b, n: int, theta: float, parts: int):
    """Replicate each set to the regions of its window; per slice and task of the next step one row of packed arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = (*hot_b.value, sieved(hot_b.value[0]))
        for batch in c.slices(batches, "_text"):
            rids, cells, far = (c.ints(batch.column(x)) for x in ("_rid", "cell", "far"))
            for low in range(0, len(rids), 60_000):
                part = batch.slice(low, 60_000)
                heads, entries = np.zeros(part.num_rows, _HEAD), []
                for i, grams in enumerate(gram_keys(part.column("_text"), n, levels_b.value, hot)):
                    size = len(grams)
                    if not size:
                        continue
                    window = grams[: int(window_size(np.float64(size), theta))]
                    heads[i] = rids[low + i], cells[low + i], size, far[low + i]
                    e = np.empty(len(window), _ENTRY)
                    e["low"], e["high"] = window & np.uint64(0xFFFFFFFF), window >> np.uint64(32)
                    e["ref"] = i
                    entries.append(e[window >> np.uint64(_HASH_BITS) > 0])  # a word that occurs once is in no other document
                all_e = np.concatenate(entries) if entries else np.empty(0, _ENTRY)
                to = (c.mix(_keys(all_e)) % np.uint64(parts)).astype(np.int64)
                at = np.argsort(to, kind="stable")
                all_e, to = all_e[at], to[at]
                bounds = np.searchsorted(to, np.arange(parts + 1))
                blobs, ids = [], []
                for p in range(parts):
                    e = all_e[bounds[p] : bounds[p + 1]]
                    if len(e):
                        refs, back = np.unique(e["ref"], return_inverse=True)
                        e = e.copy()
                        e["ref"] = back
                        blobs.append(np.uint32(len(refs)).tobytes() + heads[refs].tobytes() + e.tobytes())
                        ids.append(p)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    return run


def region_pairs(heads: np.ndarray, entries: np.ndarray, owner: np.ndarray, theta: float, tasks: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs that meet in the regions of ``entries``: (rid, greater rid, regions met in, least number needed, last), in several parts.

    ``owner`` indexes ``heads``.  A pair may come in more than one part; ``last`` is 1 in the last part.
    Of that, pairs that met in less than one of 2 * ``tasks`` shares of what they need are left out, and pairs
    of one cell that are near by their distances to its centre are never made.
    """
    _, cell = np.unique(heads["cell"], return_inverse=True)
    least = np.full(len(heads), np.iinfo(np.int64).max)
    np.minimum.at(least, cell, heads["size"].astype(np.int64))
    at = np.lexsort((heads["rid"], heads["far"], cell, least[cell]))  # cells by their least set, then by distance: so regions need sorting by key only
    number = np.empty(len(heads), np.int32)
    number[at] = np.arange(len(heads), dtype=np.int32)
    heads, cell, least = heads[at], cell[at].astype(np.int32), least[cell[at]]
    sizes, far, near = heads["size"].astype(np.int64), heads["far"].astype(np.int32), within_reach(theta)
    owner = number[owner]
    at = np.argsort(owner, kind="stable")
    key, owner = _keys(entries[at]), owner[at]
    at = np.argsort(key, kind="stable")
    key, owner = key[at], owner[at]
    del at, entries
    none = np.zeros(0, np.int64), np.zeros(0, np.int32)
    held: list[np.ndarray] = []
    count, known = 0, none

    def merge() -> None:
        """Count what is held into ``known``, the pairs so far and their counts; only the held part is sorted."""
        nonlocal held, count, known
        codes, counts = np.unique(np.concatenate(held), return_counts=True)
        held, count = [], 0
        at = np.searchsorted(known[0], codes)
        old = at < len(known[0])
        old[old] = known[0][at[old]] == codes[old]
        known[1][at[old]] += counts[old].astype(np.int32)
        new = ~old
        if new.any():
            known = np.insert(known[0], at[new], codes[new]), np.insert(known[1], at[new], counts[new].astype(np.int32))

    def told(last: bool) -> Iterator[tuple[np.ndarray, ...]]:
        nonlocal known
        part, known = known, none
        for low in range(0, len(part[0]), PASSED_PAIRS):
            yield pairs(part[0][low : low + PASSED_PAIRS], part[1][low : low + PASSED_PAIRS], last)

    def pairs(codes: np.ndarray, counts: np.ndarray, last: bool):
        a, b = codes // len(heads), codes % len(heads)
        share = theta / (1 + theta)
        behind = np.maximum(sizes[a] - window_size(sizes[a], theta), sizes[b] - window_size(sizes[b], theta))
        need = np.maximum(np.ceil(share * (sizes[a] + sizes[b]) - behind - 1e-6), 1).astype(np.int32)
        if last:
            enough = counts * (2 * tasks) >= need
            a, b, counts, need = a[enough], b[enough], counts[enough], need[enough]
        x, y = heads["rid"][a], heads["rid"][b]
        return np.minimum(x, y), np.maximum(x, y), counts.astype(np.int32), need, np.full(len(x), int(last), np.int32)

    def meet(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal count
        alike = (sizes[x] >= theta * sizes[y] - 1e-6) & (sizes[y] >= theta * sizes[x] - 1e-6)
        if alike.any():
            held.append(x[alike].astype(np.int64) * len(heads) + y[alike])
            count += len(held[-1])

    def passed_on() -> Iterator[tuple[np.ndarray, ...]]:
        if count > HELD_PAIRS:
            merge()
            if len(known[0]) > 4 * HELD_PAIRS:
                yield from told(False)

    low = 0
    while low < len(key):
        high = min(low + 200_000, len(key))
        while high < len(key) and key[high] == key[high - 1]:
            high += 1
        k, o = key[low:high], owner[low:high]
        change = np.nonzero((k[1:] != k[:-1]) | (cell[o[1:]] != cell[o[:-1]]))[0] + 1
        ends = np.repeat(np.append(change, len(k)), np.diff(np.concatenate([[0], change, [len(k)]])))  # of an entry's cell in its region
        live, step = np.arange(len(k)), 0
        while len(live):  # against the entry `step` places behind the own cell; the cells' least sizes ascend within a region
            live = live[ends[live] + step < len(k)]
            other = ends[live] + step
            more = (k[other] == k[live]) & (sizes[o[live]] >= theta * least[o[other]] - 1e-6)
            live, other = live[more], other[more]
            meet(o[live], o[other])
            step += 1
            yield from passed_on()
        live, step = np.arange(len(k)), 1
        while len(live):  # against the entry `step` places before in the own cell; distances descend that way
            live = live[live >= step]
            other = live - step
            more = (k[other] == k[live]) & (cell[o[other]] == cell[o[live]]) & (far[o[other]] + far[o[live]] > near)
            live, other = live[more], other[more]
            meet(o[other], o[live])
            step += 1
            yield from passed_on()
        low = high
    del key, owner
    if held:
        merge()
    yield from told(True)


def _regions(theta: float, tasks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, entries, owner, base = [], [], [], 0
        for batch in batches:
            for blob in batch.column("blob"):
                data = blob.as_buffer()
                n = int(np.frombuffer(data, "<u4", 1)[0])
                heads.append(np.frombuffer(data, _HEAD, n, 4))
                e = np.frombuffer(data, _ENTRY, -1, 4 + n * _HEAD.itemsize)
                entries.append(e)
                owner.append(e["ref"].astype(np.int32) + np.int32(base))
                base += n
        if not heads:
            return
        parts = region_pairs(*_one_head_each(np.concatenate(heads), np.concatenate(owner), np.concatenate(entries)), theta, tasks)
        del batch, blob, data, e, heads, entries, owner  # region_pairs has the only copy, which it drops once sorted
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in part], ["a", "b", "met", "need", "last"])
        del parts
        c.trim()

    return run


def _one_head_each(heads: np.ndarray, owner: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    _, first, back = np.unique(heads["rid"], return_index=True, return_inverse=True)
    return heads[first], entries, back.astype(np.int32)[owner]


def _packed(batches: Iterator[pa.RecordBatch], carried: tuple[str, ...] = ("_rid",)) -> Iterator[pa.RecordBatch]:
    """Each text, compressed, and the columns ``carried`` for every bucket that needs it: smaller than its grams."""
    for batch in c.slices(batches, "_text"):
        packed = [_CODEC.compress(t.as_buffer(), asbytes=True) for t in batch.column("_text")]
        sizes = pc.binary_length(batch.column("_text")).cast(pa.int64())
        buckets = batch.column("buckets")
        rows = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(c.ints(buckets.offsets))))
        for low in range(0, len(rows), 1000):
            some = rows.slice(low, 1000)
            columns = [buckets.flatten().slice(low, 1000), *(batch.column(x).take(some) for x in carried), sizes.take(some), pa.array(packed, pa.binary()).take(some)]
            yield pa.RecordBatch.from_arrays(columns, ["place", *carried, "size", "packed"])


def _unpacked(sets: pa.Table, n: int) -> list[np.ndarray]:
    grams = []
    for low in range(0, sets.num_rows, 500):
        part = sets.slice(low, 500)
        texts = [_CODEC.decompress(b.as_buffer(), size, asbytes=True).decode() for b, size in zip(part.column("packed"), part.column("size").to_pylist())]
        grams += gram_keys(pa.array(texts, pa.string()), n)
    return grams


def _verify(n: int, theta: float):
    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        place = {r: i for i, r in enumerate(sets.column("_rid").to_pylist())}
        grams = _unpacked(sets, n)
        a, b = pairs.column("a").to_pylist(), pairs.column("b").to_pylist()
        score = np.zeros(len(a))
        by_a: dict[int, list[int]] = {}
        for i, x in enumerate(a):
            by_a.setdefault(x, []).append(i)
        for x, rows in by_a.items():
            mine = grams[place[x]]
            theirs = [grams[place[b[i]]] for i in rows]
            lengths = np.array([len(t) for t in theirs])
            flat = np.concatenate(theirs)
            at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
            hits = np.add.reduceat((mine[at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(lengths)[:-1]]))
            score[rows] = hits / (len(mine) + lengths - hits)
        keep = np.nonzero(score >= theta - 1e-12)[0]
        del grams, by_a
        c.trim()
        return pa.table({"a": pairs.column("a").take(pa.array(keep)), "b": pairs.column("b").take(pa.array(keep)), "jaccard": score[keep]})

    return run


def candidate_pairs(rows: DataFrame, n: int, theta: float, entries: int) -> DataFrame:
    """Distinct candidate pairs ``(a, b)`` of ``rows (_rid, _text, cell, far)``.

    All pairs within reach are among them, but those of one cell whose ``far`` sum up to ``within_reach``.
    """
    levels_b = rows.sparkSession.sparkContext.broadcast(word_levels(rows))
    hot_b = rows.sparkSession.sparkContext.broadcast(hot_grams(rows, levels_b, n))
    parts = c.tasks_for(entries, ENTRIES_PER_TASK)
    blobs = rows.mapInArrow(_windows(levels_b, hot_b, n, theta, parts), "part int, blob binary")
    found = blobs.repartitionById(parts, F.col("part")).select("blob").mapInArrow(_regions(theta, parts), "a bigint, b bigint, met int, need int, last int")
    met = found.groupBy("a", "b").agg(F.sum("met").alias("met"), F.max("need").alias("need"), F.sum("last").alias("told"))
    enough = met.where(F.col("met") + (parts - F.col("told")) * F.col("need") / (2.0 * parts) >= F.col("need") - 1e-6)  # a task that told nothing kept back less than its half share
    return c.stored(enough.select("a", "b"), "pairs")


def _compared(text_rows: DataFrame, pairs: DataFrame, family: str, n: int, theta: float) -> DataFrame:
    """``(a, b, jaccard)`` of the ``pairs (a, b, family)`` within reach.

    Pairs of a family go to one task, so that few sets are sent twice; a family of many pairs is cut into
    blocks of its first times blocks of its second documents.
    """
    sizes = pairs.groupBy(family).agg(F.count(F.lit(1)).alias("n"), F.ceil(F.sqrt(F.count(F.lit(1)) / PAIRS_PER_TASK)).cast("int").alias("blocks")).where("blocks > 1")
    sizes = c.small(c.stored(sizes.drop("n"), "families"), 24)
    tasks = max(c.tasks_for(pairs.count(), PAIRS_PER_TASK), c.tasks_for(pairs.select(F.explode(F.array("a", "b")).alias("a")).agg(F.approx_count_distinct("a")).first()[0], SETS_PER_TASK))
    blocks = F.coalesce("blocks", F.lit(1))
    block = [F.pmod(F.xxhash64(F.col(x)), blocks) for x in ("a", "b")]
    cut = pairs.join(sizes, family, "left").select("a", "b", F.pmod(F.xxhash64(family, *block), F.lit(tasks)).cast("int").alias("bucket"))
    cut = c.stored(cut, "bucketed")
    needed = cut.select("bucket", F.explode(F.array("a", "b")).alias("_rid")).groupBy("_rid").agg(F.collect_set("bucket").alias("buckets"))
    sets = text_rows.join(c.sized(c.stored(needed, "needed"), "buckets"), "_rid").select("_rid", "_text", "buckets").mapInArrow(_packed, "place int, _rid bigint, size bigint, packed binary")
    found = cut.groupBy("bucket").cogroup(sets.groupBy("place")).applyInArrow(_verify(n, theta), "a bigint, b bigint, jaccard double")
    return c.stored(found, "near")


def cells(text_rows: DataFrame, points: DataFrame, n: int, theta: float) -> DataFrame:
    """Voronoi cells of document pivots: ``(a, cell, far)`` of the ``points (a, m1, m2, m3)`` within reach of a centre, ``far`` in steps."""
    keys = F.array(*(F.xxhash64(F.lit(i), F.col(x), F.col(y)) for i, (x, y) in enumerate((("m1", "m2"), ("m1", "m3"), ("m2", "m3")))))
    alike = points.groupBy("m1", "m2", "m3").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("a"))
    pivots = alike.select("n", "a", F.explode(keys).alias("key")).groupBy("key").agg(F.sum("n").alias("all"), F.max_by("a", F.struct("n", -F.col("a"))).alias("pivot"))
    pivots = c.small(c.stored(pivots.where("all > 1").drop("all"), "pivots"), 32)
    asked = points.select("a", F.explode(keys).alias("key")).join(pivots, "key").where("a <> pivot").select("a", "pivot").distinct()
    asked = c.stored(asked.select("a", F.col("pivot").alias("b"), F.col("pivot").alias("family")), "asked")
    first = _compared(text_rows, asked, "family", n, theta).select("a", F.col("b").alias("pivot"), (1 - F.col("jaccard")).alias("d"))
    own = first.select(F.col("pivot").alias("a"), "pivot", F.lit(0.0).alias("d")).distinct()
    nearest = first.unionByName(own).groupBy("a").agg(F.min(F.struct("d", "pivot")).alias("of")).select("a", "of.pivot", "of.d")
    nearest = c.stored(nearest, "nearest")
    centres = nearest.where("a <> pivot").groupBy("pivot").agg(F.min(F.struct("d", "a")).alias("of")).select("pivot", F.col("of.a").alias("b"))
    again = nearest.join(c.small(c.stored(centres, "centres"), 32), "pivot").where("a <> b").select("a", "b", F.col("b").alias("family"))
    again = c.stored(again, "again")
    distances = _compared(text_rows, again, "family", n, theta)
    steps = distances.select("a", F.col("b").alias("cell"), F.ceil((1 - F.col("jaccard")) * DISTANCE_STEPS).cast("int").alias("far"))
    return c.stored(steps.unionByName(steps.select(F.col("cell").alias("a"), "cell", F.lit(0).alias("far")).distinct()), "cells")


def shared_grams(mine: list[np.ndarray], theirs: list[np.ndarray]) -> np.ndarray:
    """How many grams each set of ``mine`` has in common with each of ``theirs``: a product of matrices over the common grams, added up one by one over the rare ones."""
    flat = [np.concatenate(x) for x in (mine, theirs)]
    rows = [np.repeat(np.arange(len(x)), [len(g) for g in x]) for x in (mine, theirs)]
    grams = np.intersect1d(*flat)
    common = np.zeros((len(mine), len(theirs)), np.float32)
    if not len(grams):
        return common
    for k in (0, 1):
        at = np.minimum(np.searchsorted(grams, flat[k]), len(grams) - 1)
        known = grams[at] == flat[k]
        flat[k], rows[k] = at[known], rows[k][known]
    often = [np.bincount(x, minlength=len(grams)) for x in flat]
    many = often[0] * often[1] * 64 > len(mine) * len(theirs)
    for low in range(0, int(many.sum()), 1024):
        column = np.full(len(grams), -1)
        column[np.nonzero(many)[0][low : low + 1024]] = np.arange(min(1024, int(many.sum()) - low))
        parts = []
        for k, x in enumerate((mine, theirs)):
            own = column[flat[k]] >= 0
            parts.append(np.zeros((len(x), int((column >= 0).sum())), np.float32))
            parts[k][rows[k][own], column[flat[k][own]]] = 1
        common += parts[0] @ parts[1].T
    few = [~many[x] for x in flat]
    (g0, r0), (g1, r1) = ((flat[k][few[k]], rows[k][few[k]]) for k in (0, 1))
    order = np.argsort(g1, kind="stable")
    g1, r1 = g1[order], r1[order]
    starts, ends = np.searchsorted(g1, g0), np.searchsorted(g1, g0, side="right")
    counts = np.concatenate([[0], np.cumsum(ends - starts)])
    low = 0
    while low < len(g0):  # about a million meetings at a time
        high = max(low + 1, int(np.searchsorted(counts, counts[low] + 1_000_000, side="right")) - 1)
        n = ends[low:high] - starts[low:high]
        at = np.arange(n.sum()) + np.repeat(starts[low:high] - (counts[low:high] - counts[low]), n)
        cell, met = np.unique(np.repeat(r0[low:high], n) * len(theirs) + r1[at], return_counts=True)
        common.ravel()[cell] += met.astype(np.float32)
        low = high
    return common


def block_links(near: np.ndarray, rids: list[np.ndarray], weights: list[np.ndarray], same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(a, b, n)`` of all documents with a link in the block ``near``: ``n`` the weight of its links, ``b`` one document of the block that it is connected with, one for all so connected."""
    n_rows = len(near)
    n = [near @ weights[1].astype(np.float64), weights[0].astype(np.float64) @ near]
    label = [np.full(len(x), -1) for x in rids]
    for first in range(n_rows):
        if label[0][first] >= 0 or not near[first].any():
            continue
        rows = np.array([first])
        while len(rows):
            label[0][rows] = first
            columns = np.nonzero(near[rows].any(axis=0) & (label[1] < 0))[0]
            label[1][columns] = first
            rows = np.nonzero(near[:, columns].any(axis=1) & (label[0] < 0))[0] if len(columns) else columns
    sides = (0,) if same else (0, 1)  # the two sides of a strip with itself are the same documents
    found = [np.nonzero(label[k] >= 0)[0] for k in sides]
    parts = [(rids[k][at], rids[0][label[k][at]], np.rint(n[k][at]).astype(np.int64)) for k, at in zip(sides, found)]
    return tuple(np.concatenate(x) for x in zip(*parts))


def _block(n: int, theta: float):
    def run(sets: pa.Table) -> pa.Table:
        strip, rids, weights = (sets.column(x).to_numpy() for x in ("strip", "_rid", "w"))
        grams = _unpacked(sets, n)
        own = np.unique(strip)
        sides = [np.nonzero(strip == s)[0] for s in (own[0], own[-1])]
        if len(own) == 1 and not sets.column("same")[0].as_py():  # the other strip holds nothing
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        lists = [[grams[i] for i in side] for side in sides]
        sizes = [np.array([len(g) for g in x], np.float32) for x in lists]
        common = shared_grams(*lists)
        near = common.astype(np.float64) >= (theta - 1e-12) * (sizes[0][:, None].astype(np.float64) + sizes[1][None, :] - common)
        if len(own) == 1:
            np.fill_diagonal(near, False)
        a, b, links = block_links(near, [rids[x] for x in sides], [weights[x] for x in sides], len(own) == 1)
        del grams, lists, common, near
        c.trim()
        return pa.table({"a": a, "b": b, "n": links})

    return run


def _centre_grams(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.slices(batches, "_text"):
            grams = [g.tobytes() for g in gram_keys(batch.column("_text"), n)]
            yield pa.RecordBatch.from_arrays([batch.column("_rid"), pa.array(grams, pa.binary())], ["a", "grams"])

    return run


def _maybe_family(orders_b):
    """Points that have a min-hash from a centre's grams; an unrelated one may pass, and one that doesn't is left to the regions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = np.zeros(batch.num_rows, bool)
            for values, m in zip(orders_b.value, ("m1", "m2", "m3")):
                some |= np.isin(c.ints(batch.column(m)), values)
            yield pa.RecordBatch.from_arrays([x.filter(pa.array(some)) for x in (batch.column("a"), batch.column("w"), batch.column("size"))], ["_rid", "w", "size"])

    return run


def _nearest_centre(n: int, centres_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, flat, of = centres_b.value
        for batch in c.slices(batches, "_text"):
            best = np.full(batch.num_rows, -1)
            for i, grams in enumerate(gram_keys(batch.column("_text"), n)):
                low, high = np.searchsorted(flat, grams), np.searchsorted(flat, grams, side="right")
                low, high = low[high > low], high[high > low]
                if len(low):
                    spans = high - low
                    at = np.arange(spans.sum()) + np.repeat(low - (np.cumsum(spans) - spans), spans)
                    hits = np.bincount(of[at], minlength=len(ids))
                    score = hits / (len(grams) + sizes - hits)
                    if score.max() >= FAMILY_THETA:
                        best[i] = score.argmax()
            kept = pa.array(best >= 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(x).filter(kept) for x in ("_rid", "w", "size")), pa.array(ids[best[best >= 0]])], ["_rid", "w", "size", "family"])

    return run


def families(text_rows: DataFrame, classes: DataFrame, placed: DataFrame, n: int) -> DataFrame | None:
    """``(_rid, w, size, family)``: the points near the centre of a large cell; none if no cell is large."""
    large = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= FAMILY_LEAST).orderBy(F.desc("k"), "cell").limit(FAMILIES)
    chosen = [r["cell"] for r in large.collect()]
    if not chosen:
        return None
    spark = text_rows.sparkSession
    centres = text_rows.where(F.col("_rid").isin(chosen)).mapInArrow(_centre_grams(n), "a bigint, grams binary").collect()
    ids, sets = np.array([r["a"] for r in centres], np.int64), [np.frombuffer(r["grams"], np.uint64) for r in centres]
    flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(g) for g in sets])
    order = np.argsort(flat, kind="stable")
    centres_b = spark.sparkContext.broadcast((ids, np.array([len(g) for g in sets]), flat[order], of[order]))
    orders_b = spark.sparkContext.broadcast([np.unique(x).view(np.int64) for x in _three_orders(np.unique(flat))])
    some = c.small(c.stored(classes.select("a", "w", "size", "m1", "m2", "m3").mapInArrow(_maybe_family(orders_b), "_rid bigint, w bigint, size int"), "maybe"), 32)
    return c.stored(text_rows.join(some, "_rid").select("_rid", "w", "size", "_text").mapInArrow(_nearest_centre(n, centres_b), "_rid bigint, w bigint, size int, family bigint"), "members")


def family_links(text_rows: DataFrame, members: DataFrame, n: int, theta: float) -> DataFrame:
    """``(a, b, n)``: per document and block, the number of rows it is linked to there, and a document it is connected with."""
    of, base = {}, 0
    for r in members.groupBy("family").agg(F.count(F.lit(1)).alias("k"), F.sum("size").alias("grams")).orderBy("family").collect():  # FAMILIES at most
        strips = max(1, -(-r["k"] // STRIP_SETS), -(-r["grams"] // STRIP_GRAMS))
        of[r["family"]] = (strips, base)
        base += strips * strips
    known = members.sparkSession.createDataFrame(pa.table({"family": pa.array(list(of), pa.int64()), "strips": pa.array([x[0] for x in of.values()], pa.int32()), "base": pa.array([x[1] for x in of.values()], pa.int32())}))
    strip = members.join(F.broadcast(known), "family").withColumn("strip", F.pmod(F.xxhash64("_rid"), F.col("strips")).cast("int"))
    other = F.transform(F.sequence(F.lit(0), F.col("strips") - 1), lambda t: F.col("base") + F.least("strip", t) * F.col("strips") + F.greatest("strip", t))
    sent = c.small(c.stored(strip.select("_rid", "w", "strip", F.transform(other, lambda x: x.cast("int")).alias("buckets"), (F.col("base") + F.col("strip") * (F.col("strips") + 1)).alias("alone")), "strips"), 512)
    carried = ("_rid", "w", "strip", "alone")
    packed = text_rows.join(sent, "_rid").select("_text", "buckets", *carried).mapInArrow(lambda batches: _packed(batches, carried), "place int, _rid bigint, w bigint, strip int, alone int, size bigint, packed binary")
    packed = packed.withColumn("same", F.col("place") == F.col("alone")).drop("alone")
    return c.stored(packed.groupBy("place").applyInArrow(_block(n, theta), "a bigint, b bigint, n bigint"), "blocks")


def _near(df: DataFrame, n: int, theta: float, id_col: str, text_col: str, pivots: bool = True):
    """``_linked`` without families."""
    return _linked(df, n, theta, id_col, text_col, pivots, wide=False)[:-1]


def _linked(df: DataFrame, n: int, theta: float, id_col: str, text_col: str, pivots: bool = True, wide: bool = True):
    """``df`` with row numbers, all rows, whether those are the ids, classes ``(a, w)`` of equal sets, copies ``(a, b)`` of a class's least row, cells, near pairs ``(a, b, jaccard)`` of least rows, and links ``(a, b, n)`` inside of families."""
    if not 0 < theta <= 1 or n < 1:
        raise ValueError("theta must be in (0, 1] and n at least 1")
    tagged, rows, unique = c.with_row_ids(df, id_col, text_col)
    text_rows = rows.select("_rid", "_text")
    sums = c.stored(text_rows.mapInArrow(_summaries(n), _SUMMARY), "sets").where("size > 0")
    same = ["size", "s1", "s2"]
    classes = sums.groupBy(*same).agg(F.min("_rid").alias("a"), F.count(F.lit(1)).alias("w"), *(F.min(m).alias(m) for m in ("m1", "m2", "m3")))
    classes = c.stored(classes, "classes")
    several = c.small(c.stored(classes.where("w > 1").select(*same, "a"), "several"), 64)
    copies = c.stored(sums.join(several, same).where("_rid <> a").select("a", F.col("_rid").alias("b")), "copies")
    nothing = tagged.sparkSession.range(0)  # createDataFrame of a list would start Python workers of another kind, which stay
    none = nothing.select(F.col("id").alias("a"), F.col("id").alias("cell"), F.col("id").cast("int").alias("far"))
    placed = cells(text_rows, classes.select("a", "m1", "m2", "m3"), n, theta) if pivots else none
    members = families(text_rows, classes, placed, n) if pivots and wide else None
    inside = nothing.select(F.col("id").alias("a"), F.col("id").alias("b"), F.col("id").alias("n"))
    if members is not None:
        inside = family_links(text_rows, members, n, theta)
        taken = c.small(members.select("_rid", "family"), 24)
        around = F.broadcast(members.select(F.col("family").alias("cell")).distinct())  # a family has its centre's number: what is left of the centre's cell goes single
        left = placed.join(taken.select(F.col("_rid").alias("a")), "a", "left_anti").join(around, "cell", "left_anti").select("a", "cell", "far")
        placed = c.stored(left, "left")
        marks = placed.unionByName(members.select(F.col("_rid").alias("a"), F.col("family").alias("cell"), F.lit(0).alias("far")))
    else:
        marks = placed
    marks = copies.select(F.col("b").alias("_rid"), F.lit(None).cast("bigint").alias("cell"), F.lit(-1).alias("far")).unionByName(marks.withColumnRenamed("a", "_rid"))
    chosen = text_rows.join(c.small(c.stored(marks, "marks"), 48), "_rid", "left").where("far is null or far >= 0")
    chosen = chosen.select("_rid", "_text", F.coalesce("cell", "_rid").alias("cell"), F.coalesce("far", F.lit(0)).alias("far"))
    entries = int((1 - theta) * (classes.agg(F.sum("size")).first()[0] or 0)) + 1
    pairs = candidate_pairs(chosen, n, theta, entries)
    ends = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = c.small(c.stored(ends.groupBy("a").agg(F.least("a", F.min("b")).alias("label")), "labels"), 32)
    label = c.stored(ends.join(near.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("label")), "labels")
    label = c.small(label, 32)  # pairs of one family mostly have one label
    both = pairs.join(label.withColumnRenamed("label", "label_a"), "a").join(label.select(F.col("a").alias("b"), F.col("label").alias("label_b")), "b")
    found = _compared(text_rows, c.stored(both.select("a", "b", F.least("label_a", "label_b").alias("family")), "families"), "family", n, theta)
    return tagged, rows, unique, classes.select("a", "w"), copies, placed, found, inside


def near_classes(df: DataFrame, n: int = 2, theta: float = 0.65, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, class_id, n_links)``, one row per row of ``df``.

    ``n_links`` is the number of other rows with Jaccard similarity at least ``theta`` (0 < theta <= 1) of the
    word n-gram sets, copies among them.  Rows are of one class if such links lead from one to the other;
    ``class_id`` is the id of its least row, in the order of the ids (null last): the own id without any link.
    """
    _, rows, unique, classes, copies, placed, found, blocks = _linked(df, n, theta, id_col, text_col)
    reach = within_reach(theta)
    weights = c.small(c.stored(classes.where("w > 1"), "weights"), 32)

    def weighted(part: DataFrame, row: str) -> DataFrame:
        return part.join(weights.select(F.col("a").alias(row), F.col("w").alias("_w")), row, "left").withColumn("w", F.coalesce("_w", F.lit(1))).drop("_w")

    ends = found.select("a", "b").unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    by_pair = weighted(ends, "b").groupBy("a").agg(F.sum("w").alias("n"))
    inside = c.stored(weighted(placed, "a"), "inside")
    counts = inside.groupBy("cell", "far").agg(F.sum("w").alias("w")).groupBy("cell").agg(F.collect_list(F.struct("far", "w")).alias("rows"))  # at most one entry per step
    sums = F.aggregate(F.filter("rows", lambda y: y["far"] + F.col("x.far") <= reach), F.lit(0).cast("bigint"), lambda s, y: s + y["w"])
    counts = c.small(c.stored(counts.select("cell", "rows", F.explode("rows").alias("x")).select("cell", F.col("x.far").alias("far"), sums.alias("n")), "counts"), 32)
    by_cell = inside.join(counts, ["cell", "far"]).select("a", (F.col("n") - F.when(2 * F.col("far") <= reach, F.col("w")).otherwise(0)).alias("n"))
    by_copy = classes.where("w > 1").select("a", (F.col("w") - 1).alias("n"))
    links = c.stored(by_pair.unionByName(by_cell).unionByName(by_copy).unionByName(blocks.select("a", "n")).groupBy("a").agg(F.sum("n").alias("n_links")).where("n_links > 0"), "links")
    labels = components(_edges(found, placed, blocks))
    linked = links.join(labels, "a", "left").select("a", "n_links", F.coalesce("label", "a").alias("label"))
    linked = c.stored(linked, "linked")
    each = linked.withColumnRenamed("a", "_rid").unionByName(copies.join(c.small(linked, 32), "a").select(F.col("b").alias("_rid"), "n_links", "label"))
    each = c.small(c.stored(each, "each"), 32)
    out = rows.select("_rid", "_id").join(each, "_rid", "left").select("_id", F.coalesce("label", "_rid").alias("label"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    kind = df.schema[id_col].dataType
    if unique:
        return out.select(F.col("_id").alias("doc_id"), F.col("label").cast(kind).alias("class_id"), "n_links")
    return out.join(rows.select(F.col("_rid").alias("label"), F.col("_id").alias("class_id")), "label").select(F.col("_id").alias("doc_id"), "class_id", "n_links")


def near_pairs(df: DataFrame, n: int = 2, theta: float = 0.65, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_a, doc_b, jaccard)``: all near pairs of different sets, by the least row of either, and each copy beside the least row with its set (1.0).

    The pairs of a family of near copies grow with the square of its size; ``near_classes`` does without them.
    """
    _, rows, unique, _, copies, _, found = _near(df, n, theta, id_col, text_col, pivots=False)
    pairs = found.unionByName(copies.withColumn("jaccard", F.lit(1.0)))
    if unique:
        return pairs.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), "jaccard")
    for side in ("a", "b"):
        pairs = pairs.join(rows.select(F.col("_rid").alias(side), F.col("_id").alias("doc_" + side)), side)
    return pairs.select("doc_a", "doc_b", "jaccard")


def _edges(found: DataFrame, placed: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(a, b)``: links and connections that lead from any row of a class to any other."""
    of_cells = placed.where("a <> cell").select("a", F.col("cell").alias("b"))
    return found.select("a", "b").unionByName(of_cells).unionByName(blocks.where("a <> b").select("a", "b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """``(a, label)``: the least row of the connected component of every row of ``edges (a, b)``.

    Every row is hooked to its least neighbour's label until nothing changes; the number of rounds grows with
    the logarithm of a component's diameter, as labels are also followed to their own labels.
    """
    edges = c.stored(edges, "edges")
    edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = c.stored(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, "a").select("a", "label", F.least("label", "near").alias("new"))
        jumped = hooked.alias("x").join(labels.select(F.col("a").alias("new"), F.col("label").alias("far")), "new")
        done = c.stored(jumped.select("a", F.least("new", "far").alias("label"), (F.least("new", "far") < F.col("label")).alias("moved")), "labels")
        labels = done.select("a", "label")
        if not done.where("moved").limit(1).count():
            return labels


def drop_near_copies(df: DataFrame, n: int = 2, theta: float = 0.65, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the least row of each class of ``near_classes``."""
    tagged, _, _, _, copies, placed, found, blocks = _linked(df, n, theta, id_col, text_col)
    labels = components(_edges(found, placed, blocks))
    gone = labels.where("a <> label").select(F.col("a").alias("_rid")).unionByName(copies.select(F.col("b").alias("_rid")))
    return c.restored(tagged.join(c.small(c.stored(gone, "gone"), 16), "_rid", "left_anti"), df)


def window_share(df: DataFrame, n: int = 2, theta: float = 0.65, pivots: int = 64, text_col: str = "text") -> DataFrame:
    """What document pivots alone would replicate: ``(pivots, mean_share)``, the mean share of ``pivots`` cells that a document reaches by d(x, q) <= d(x, p) + 2 r.

    The pivots are the rows with the least hashes of their texts, a measurement's parameter; all documents are measured.
    """
    rows = df.select(F.col(text_col).cast("string").alias("_text")).where("_text is not null")
    chosen = [r["_text"] for r in rows.select("_text").distinct().orderBy(F.xxhash64("_text")).limit(pivots).collect()]
    sets = [g for g in gram_keys(pa.array(chosen, pa.string()), n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = count = 0
        for batch in c.slices(batches, "_text"):
            for grams in gram_keys(batch.column("_text"), n):
                if len(grams):
                    common = np.array([len(np.intersect1d(grams, p, assume_unique=True)) for p in sets])
                    d = 1 - common / (len(grams) + np.array([len(p) for p in sets]) - common)
                    total, count = total + int((d <= d.min() + 2 * (1 - theta)).sum()), count + 1
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([count], pa.int64())], ["reached", "n"])

    reached = rows.mapInArrow(run, "reached bigint, n bigint").agg(F.sum("reached").alias("reached"), F.sum("n").alias("n"))
    return reached.select(F.lit(len(sets)).alias("pivots"), (F.col("reached") / F.col("n") / len(sets)).alias("mean_share"))
