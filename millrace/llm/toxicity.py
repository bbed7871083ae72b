"""Toxicity (operator 10): FTRL-proximal logistic regression over hashed word features.

Features are the words of a document, its word pairs and its pairs with one word skipped, hashed
into 2**20 places; a feature counts once per document.  Training is FTRL-proximal with a learning
rate per coordinate and L1, on a bounded number of labelled documents (``per_class``, a parameter);
one task trains, the few weights that are not zero are broadcast, and every document of the corpus is scored
whole.

Defined cases: null texts and texts without words score the bias alone and are not toxic unless
the training documents mostly were; a text with one word has one feature; repeated rows are scored
alike; labels that are null or without a document are not trained on, and a document that is toxic by one of its
labels is toxic; without any labelled
document nothing is toxic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common as c

BITS = 20
PER_CLASS, PASSES = 4_000, 12
ALPHA, BETA, L1, L2 = 4.0, 1.0, 8.0, 0.1
THRESHOLD = 0.5
#: Bytes of text that are made into features at once: these take about 60 times as many, in every worker of an executor.
SLICE_BYTES = 1 << 19

_CODEC = pa.Codec("zstd", 3)
_SALTS = c.mix(np.arange(11, 14, dtype=np.uint64))


def features(codes: np.ndarray, offsets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(place, document)`` of all features of all documents, with repeats."""
    h = hashes[codes]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    places, docs = [c.mix(h ^ _SALTS[0])], [doc]
    for gap in (1, 2):
        same = doc[gap:] == doc[:-gap]
        places.append(c.mix(h[:-gap] * c._BASE + c.mix(h[gap:] ^ _SALTS[gap]))[same])
        docs.append(doc[gap:][same])
    return (np.concatenate(places) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(docs)


def train(examples: list[np.ndarray], labels: np.ndarray, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over sets of places; returns the places with weights, the weights, and the bias."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS

    def weights(at: np.ndarray) -> np.ndarray:
        shrink = np.where(at == bias, 0.0, L1)
        zs = z[at]
        return np.where(np.abs(zs) <= shrink, 0.0, -(zs - np.sign(zs) * shrink) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(passes):
        for i in order.permutation(len(examples)):
            at = np.append(examples[i], np.int32(bias))
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(bias))
    kept = np.nonzero(w)[0]
    return kept, w[kept], float(weights(np.array([bias]))[0])


_EXAMPLES = "toxic binary, sizes binary, steps binary, n_steps bigint, n bigint"


def _example_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The examples of each slice as one row of packed arrays: labels, numbers of places, and the differences of places that follow each other."""
    for batch in c.slices(batches, "_text", SLICE_BYTES):
        codes, offsets, words = c.split_words(batch.column("_text"))
        place, doc = features(codes, offsets, c.hash_words(words))
        pairs = np.unique(doc << BITS | place)
        ends = np.searchsorted(pairs >> BITS, np.arange(batch.num_rows + 1))
        steps = np.diff(pairs & ((1 << BITS) - 1), prepend=0).astype("<i4")
        parts = c.ints(batch.column("toxic")).astype("<i4"), np.diff(ends).astype("<i4"), steps
        yield pa.RecordBatch.from_arrays([pa.array([_CODEC.compress(x.tobytes(), asbytes=True)]) for x in parts] + [pa.array([len(steps)], pa.int64()), pa.array([batch.num_rows], pa.int64())], _EXAMPLES.replace(" binary", "").replace(" bigint", "").split(", "))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on at most ``per_class`` labelled documents of either class, chosen by the hash of their id."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    chosen = None
    for value in (0, 1):
        some = known.where(F.col("toxic") == value).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    chosen = F.broadcast(c.stored(chosen, "labelled"))  # at most 2 * per_class rows
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(chosen, "_id").select("toxic", "_text", F.xxhash64("_id").alias("o"))
    examples = rows.select("toxic", "_text").mapInArrow(_example_rows, _EXAMPLES)
    weights = c.stored(examples.repartition(1).mapInArrow(_fitted, "places binary, weights binary, bias double"), "weights").first()  # at most 2 * per_class examples in that task
    if weights is None:
        return np.zeros(0, np.int64), np.zeros(0), -35.0
    return np.frombuffer(weights["places"], np.int64), np.frombuffer(weights["weights"], np.float64), weights["bias"]


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Train on all examples, in an order of their own, as rows arrive in any."""
    found = []
    for batch in batches:
        for toxic, sizes, steps, n_steps, n in zip(*(column.to_pylist() for column in batch.columns)):
            labels, lengths, steps = (np.frombuffer(_CODEC.decompress(x, 4 * k, asbytes=True), "<i4") for x, k in ((toxic, n), (sizes, n), (steps, n_steps)))
            values, ends = np.cumsum(steps, dtype=np.int32), np.cumsum(lengths)
            found += [(values[b - k : b], y) for b, k, y in zip(ends.tolist(), lengths.tolist(), labels.tolist())]
    if found:
        found.sort(key=lambda x: (len(x[0]), xxhash.xxh3_128_digest(x[0].tobytes()), x[1]))
        places, weights, bias = train([x for x, _ in found], np.array([y for _, y in found], np.float64))
        del found
        c.trim()
        yield pa.RecordBatch.from_arrays([pa.array([places.tobytes()]), pa.array([weights.tobytes()]), pa.array([bias])], ["places", "weights", "bias"])


def _scores(weights_b, text: str):
    """Adds ``toxicity``, by the column ``text``, to all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, weights, bias = weights_b.value
        table = np.zeros(1 << BITS, np.float64)
        table[places] = weights
        for batch in c.slices(batches, text, SLICE_BYTES):
            codes, offsets, words = c.split_words(batch.column(text))
            place, doc = features(codes, offsets, c.hash_words(words))
            counts = np.nonzero(table[place])[0]
            pairs = np.unique(doc[counts] << BITS | place[counts])
            total = bias + np.bincount(pairs >> BITS, weights=table[pairs & ((1 << BITS) - 1)], minlength=batch.num_rows)
            kept = [name for name in batch.schema.names if name != "_text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], [*kept, "toxicity"])
        c.trim()

    return run


def score(df: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, toxicity, is_toxic)`` of every row of ``df``."""
    weights_b = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scores(weights_b, "_text"), f"doc_id {kind}, toxicity double").withColumn("is_toxic", F.col("toxicity") >= threshold)


def drop_toxic(df: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` without the rows that are toxic."""
    weights_b = df.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(len(df.columns))]
    plain = df.toDF(*names)
    rows, text = plain, names[df.columns.index(text_col)]
    if dict(plain.dtypes)[text] != "string":  # else the text goes to the workers once
        rows, text = plain.withColumn("_text", F.col(text).cast("string")), "_text"
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, df.schema.fields))
    scored = rows.mapInArrow(_scores(weights_b, text), schema + ", toxicity double")
    return scored.where(F.col("toxicity") < threshold).drop("toxicity").toDF(*df.columns)
