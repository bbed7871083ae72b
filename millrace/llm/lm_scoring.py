"""LM scoring (operator 7) with a log-bilinear model trained by noise-contrastive estimation.

The vocabulary is every word of the corpus, counted over all documents.  Words are predicted through
classes: each of the commonest words is a class by itself, the others are put together by how often
they occur, their length and their last letters, in about as many classes as the square root of
their number.  A word's probability is that of its class after the two classes before it, times its
share of the occurrences of its class.  The table of words leaves out the rarest, those that occur once and
as many counts above as keep it within ``LISTED`` words: a word that isn't in it finds its class by its letters
and has the mean count of the words that were left out of that class, so that shares still sum to 1.

The context predicts the class: the sum of the two context vectors (one table per position) is
multiplied with the target vectors, plus a bias.  As context, the classes of several words share their
vectors in up to 32 groups, or else there would be too many contexts to normalise.  Training goes once over every word of the corpus:
each task starts from the same parameters, takes steps of noise-contrastive estimation in numpy (one
set of noise classes per step, so that a step is a few matrix products), and the tasks' parameters
are averaged, weighted by their words.

Scores are normalised: for each context that occurs, one row of a matrix product over all classes
gives its log partition function.  A cache of fixed size remembers the latest of them.

Defined cases: null texts have null scores; texts without words have no tokens, an empty list and a
null mean; contexts begin with a word that is outside every text; repeated rows are scored alike;
a word that the training corpus lacks is scored like one that occurs there once; an empty corpus
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common as c

VOCABULARY, WIDTH, NOISE, STEP = 4096, 16, 64, 4096
RATE = 0.1
#: Words in the table that goes to all workers, 20 bytes each.
LISTED = 2_000_000
_OTHER, _START = 0, 1
_SHARDS = 16
#: Levels of how often a word occurs, and bands of its length, that tell classes apart; log partition functions that a scorer remembers.
_LEVELS, _BANDS, _REMEMBERED = 40, 4, 1 << 22


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in c.slices(batches, "_text", 4 * c.SLICE_BYTES):
        codes, _, words = c.split_words(batch.column("_text"))
        counts = np.bincount(codes, minlength=len(words))
        some = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([words.cast(pa.string()).take(pa.array(some)), pa.array(counts[some].astype(np.int64))], ["word", "n"])


def _signature(words: pa.Array, counts: np.ndarray, spread: int) -> np.ndarray:
    """Words of one signature share a class: the count's power of 2, the length in fours, and one of ``spread`` groups of endings."""
    words = words.cast(pa.large_binary())
    ends = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    length = np.diff(ends)
    last = data[ends[1:] - 1].astype(np.uint64) << np.uint64(8)
    last |= np.where(length > 1, data[np.maximum(ends[1:] - 2, 0)], 0).astype(np.uint64)
    level = np.minimum(np.log2(counts).astype(np.int64), _LEVELS - 1)
    return (level * _BANDS + np.minimum((length - 1) // 4, _BANDS - 1)) * spread + (c.mix(last ^ c._BASE) % np.uint64(spread)).astype(np.int64)


def _other_words(head_b, spread: int, least: int):
    """Of the words that are not in the head: hash, signature and count of those that occur ``least`` times or more, and how many the rest of each signature are and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        rare = np.zeros((2, _BANDS * spread), np.int64)
        for batch in batches:
            words, n = batch.column("word"), c.ints(batch.column("n"))
            hashes = c.hash_words(words)
            some = np.nonzero(~np.isin(hashes, head_b.value))[0]
            if not len(some):
                continue
            hashes, n = hashes[some], n[some]
            more = n >= least
            of = _signature(words.take(pa.array(some)), np.where(more, n, 1), spread)
            np.add.at(rare[0], of[~more], 1)
            np.add.at(rare[1], of[~more], n[~more])
            found.append((hashes[more].astype("<u8"), of[more].astype("<i4"), n[more].astype("<i8")))
        if found:
            parts = *(np.concatenate(x) for x in zip(*found)), *rare
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], ["hashes", "of", "n", "rare", "rare_n"])

    return run


class Vocabulary:
    """Classes of words by hash, and the words' shares of them: 0 is a word whose class the corpus lacks, 1 stands before a text.

    ``context`` has the class whose context vectors a class uses.
    """

    def __init__(self, words: list[str], counts: np.ndarray, others: list, spread: int = 1) -> None:
        read = lambda name, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(r[name], kind) for r in others)])
        hashes, of, n = read("hashes", "<u8"), read("of", "<i4"), read("n", "<i8")
        total = np.bincount(of, weights=n, minlength=_LEVELS * _BANDS * spread)
        rare, rare_n = np.zeros(len(total)), np.zeros(len(total))
        for r in others:
            rare[: _BANDS * spread] += np.frombuffer(r["rare"], "<i8")
            rare_n[: _BANDS * spread] += np.frombuffer(r["rare_n"], "<i8")
        total = total + rare_n
        used = np.nonzero(total)[0]
        self.spread = spread
        self.class_of = np.full(len(total), _OTHER, np.int64)
        self.class_of[used] = np.arange(len(used)) + len(words) + 2
        self.once = np.log(np.where(rare > 0, rare_n / np.maximum(rare, 1), 1) / np.maximum(total, 1)).astype(np.float32)
        hashes = np.concatenate([c.hash_words(pa.array(words, pa.string())), hashes])
        at = np.argsort(hashes)
        self.hashes = hashes[at]
        self.ids = np.concatenate([np.arange(len(words)) + 2, self.class_of[of]])[at].astype(np.int32)
        self.within = np.concatenate([np.zeros(len(words)), np.log(n / total[of])])[at].astype(np.float32)
        self.size = len(words) + len(used) + 2
        group = (used // spread // _BANDS > 0) * 4 * _BANDS + used // spread % _BANDS * 4 + used % spread % 4
        _, first, back = np.unique(group, return_index=True, return_inverse=True)
        self.context = np.concatenate([np.arange(len(words) + 2), first[back] + len(words) + 2])
        share = np.concatenate([[1, 1], counts, total[used]]).astype(np.float64)
        self.share = share / share.sum()

    def find(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The class of each word, and the logarithm of its share of the class."""
        of = _signature(words, np.ones(len(words)), self.spread)
        ids, within = self.class_of[of], self.once[of]
        if len(self.hashes):
            h = c.hash_words(words)
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            known = self.hashes[at] == h
            ids, within = np.where(known, self.ids[at], ids), np.where(known, self.within[at], within)
        return ids, within


def build_vocabulary(rows: DataFrame, size: int = VOCABULARY) -> Vocabulary:
    """All words of ``rows``; the ``size - 2`` commonest are classes by themselves."""
    counts = c.stored(rows.select("_text").mapInArrow(_word_counts, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    top = counts.orderBy(F.desc("n"), "word").limit(size - 2).collect()
    words = [r["word"] for r in top]
    spread = max(1, math.ceil(math.sqrt(counts.count() - len(words)) / (8 * _BANDS)))
    head_b = rows.sparkSession.sparkContext.broadcast(c.hash_words(pa.array(words, pa.string())))
    often = counts.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).collect()
    least, listed = 1 << 17, -len(words)
    for r in often:
        listed += r["words"]
        if r["n"] == 1 or listed > LISTED:
            break
        least = r["n"]
    columns = ("hashes", "of", "n", "rare", "rare_n")
    others = counts.mapInArrow(_other_words(head_b, spread, least), ", ".join(f"{x} binary" for x in columns)).collect()
    return Vocabulary(words, np.array([r["n"] for r in top], np.int64), others, spread)


def contexts(texts: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(two before, one before, class, log share of the class, offsets)`` of all words of all texts."""
    codes, offsets, words = c.split_words(texts)
    ids, within = vocabulary.find(words)
    w = ids[codes]
    before = vocabulary.context[w]
    place = np.arange(len(w)) - np.repeat(offsets[:-1], np.diff(offsets))
    one = np.where(place >= 1, np.concatenate([[_START], before[:-1]])[: len(w)], _START)
    two = np.where(place >= 2, np.concatenate([[_START, _START], before[:-2]])[: len(w)], _START)
    return two, one, w, within[codes], offsets


class Model:
    """Parameters in one float32 vector: context tables of both positions, target table, biases."""

    def __init__(self, size: int, width: int, data: np.ndarray) -> None:
        self.size, self.width, self.data = size, width, data
        n = size * width
        self.two, self.one, self.target = (data[i * n : (i + 1) * n].reshape(size, width) for i in range(3))
        self.bias = data[3 * n :]

    @classmethod
    def fresh(cls, vocabulary: Vocabulary, width: int = WIDTH) -> Model:
        rng = np.random.default_rng(5)
        data = (rng.standard_normal(vocabulary.size * (3 * width + 1)) * 0.1).astype(np.float32)
        data[3 * vocabulary.size * width :] = np.log(vocabulary.share)
        return cls(vocabulary.size, width, data)


def _add_rows(table: np.ndarray, rows: np.ndarray, change: np.ndarray, seen: np.ndarray) -> None:
    """AdaGrad on the rows: sum the changes of equal rows, then divide by the root of the squares so far."""
    size, width = table.shape
    if width == 1:
        total = np.bincount(rows, weights=change, minlength=size)[:, None]
    else:
        total = np.bincount((rows[:, None] * width + np.arange(width)).ravel(), weights=change.ravel(), minlength=size * width).reshape(size, width)
    r = np.nonzero(np.bincount(rows, minlength=size))[0]
    total = total[r].astype(np.float32)
    seen[r] += np.einsum("ij,ij->i", total, total) / width
    table[r] -= RATE * total / np.sqrt(seen[r] + 1e-6)[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; overflow to infinity gives 0."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Trainer:
    """Noise-contrastive estimation in steps of ``STEP`` words."""

    def __init__(self, model: Model, share: np.ndarray, seed: int = 1) -> None:
        self.m, self.rng = model, np.random.default_rng(seed)
        self.log_noise = np.log(share * NOISE).astype(np.float32)
        self.cumulative = np.cumsum(share)
        self.seen = [np.full(model.size, 0.1, np.float32) for _ in range(4)]
        self.words = 0

    def step(self, two: np.ndarray, one: np.ndarray, word: np.ndarray) -> None:
        m = self.m
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE)), m.size - 1)
        q = m.two[two] + m.one[one]
        t, v = m.target[word], m.target[noise]
        s = np.einsum("ij,ij->i", q, t) + m.bias[word] - self.log_noise[word]
        sn = q @ v.T
        sn += m.bias[noise] - self.log_noise[noise]
        g = -_sigmoid(-s)
        gn = _sigmoid(sn)
        dq = gn @ v
        t *= g[:, None]
        dq += t
        dv = gn.T @ q
        q *= g[:, None]
        rows = np.concatenate([word, noise])
        _add_rows(m.two, two, dq, self.seen[0])
        _add_rows(m.one, one, dq, self.seen[1])
        _add_rows(m.target, rows, np.concatenate([q, dv]), self.seen[2])
        _add_rows(m.bias[:, None], rows, np.concatenate([g, gn.sum(0)]), self.seen[3])
        self.words += len(word)

    def run(self, two: np.ndarray, one: np.ndarray, word: np.ndarray) -> None:
        for i in range(0, len(word), STEP):
            self.step(two[i : i + STEP], one[i : i + STEP], word[i : i + STEP])


def _train(shared_b):
    """One task's pass over its words; its parameters leave in shards, with the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, width, start = shared_b.value
        trainer = Trainer(Model(vocabulary.size, width, start.copy()), vocabulary.share)
        for batch in c.slices(batches, "_text", 2 * c.SLICE_BYTES):
            two, one, word, _, _ = contexts(batch.column("_text"), vocabulary)
            trainer.run(two, one, word)
        if trainer.words:
            parts = np.array_split(trainer.m.data, _SHARDS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(_SHARDS), pa.int32()), pa.array([trainer.words] * _SHARDS, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["shard", "words", "data"]
            )

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted mean per shard, one blob at a time."""
    total: dict[int, list] = {}
    for batch in batches:
        for shard, words, data in zip(batch.column("shard").to_pylist(), batch.column("words").to_pylist(), batch.column("data").to_pylist()):
            have = total.setdefault(shard, [0, 0.0])
            have[0] += words
            have[1] = have[1] + words * np.frombuffer(data, np.float32).astype(np.float64)
    for shard, (words, data) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([words], pa.int64()), pa.array([(data / words).astype(np.float32).tobytes()], pa.binary())], ["shard", "words", "data"])


_SHARD = "shard int, words bigint, data binary"


def train(rows: DataFrame, size: int = VOCABULARY, width: int = WIDTH) -> tuple[Vocabulary, Model]:
    """Vocabulary and model from all of ``rows (_rid, _text)``."""
    spark = rows.sparkSession
    vocabulary = build_vocabulary(rows, size)
    model = Model.fresh(vocabulary, width)
    shared_b = spark.sparkContext.broadcast((vocabulary, width, model.data))
    shards = rows.select("_text").mapInArrow(_train(shared_b), _SHARD).repartitionById(_SHARDS, F.col("shard")).mapInArrow(_average, _SHARD)
    parts = {r["shard"]: np.frombuffer(r["data"], np.float32) for r in shards.collect()}
    if parts:
        model = Model(vocabulary.size, width, np.concatenate([parts[i] for i in range(_SHARDS)]))
    return vocabulary, model


class Scorer:
    """Normalised log-probabilities of classes; remembers the log partition functions of contexts, each at one place of a table."""

    def __init__(self, model: Model) -> None:
        self.m = model
        self.contexts, self.log_z = np.full(_REMEMBERED, -1, np.int64), np.zeros(_REMEMBERED, np.float32)
        self._targets = np.ascontiguousarray(np.vstack([model.target.T, model.bias[None]]))
        self._reach = float(np.sqrt((model.target**2).sum(1)).max()), float(np.abs(model.bias).max())

    def _log_z(self, pairs: np.ndarray) -> np.ndarray:
        """One row of scores over the classes per context, the biases as a last column; blocks that fit the cache."""
        m = self.m
        out = np.empty(len(pairs), np.float32)
        for i in range(0, len(pairs), 128):
            some = pairs[i : i + 128]
            q = np.ones((len(some), m.width + 1), np.float32)
            q[:, :-1] = m.two[some // m.size] + m.one[some % m.size]
            s = q @ self._targets
            top = 0.0
            if np.sqrt((q[:, :-1] ** 2).sum(1)).max() * self._reach[0] + self._reach[1] > 60:  # exp could overflow
                top = s.max(1)
                s -= top[:, None]
            np.exp(s, out=s)
            out[i : i + 128] = np.log(s.sum(1)) + top
        return out

    def score(self, two: np.ndarray, one: np.ndarray, word: np.ndarray) -> np.ndarray:
        m = self.m
        pairs, back = np.unique(two.astype(np.int64) * m.size + one, return_inverse=True)
        at = (c.mix(pairs.view(np.uint64)) % np.uint64(_REMEMBERED)).astype(np.int64)
        log_z = self.log_z[at]
        new = self.contexts[at] != pairs
        log_z[new] = self._log_z(pairs[new])
        self.contexts[at[new]] = pairs[new]
        last = new & (self.contexts[at] == pairs)  # of contexts that fall on one place, one stays
        self.log_z[at[last]] = log_z[last]
        q = m.two[two] + m.one[one]
        return np.einsum("ij,ij->i", q, m.target[word]) + m.bias[word] - log_z[back]


_scorers: dict[int, Scorer] = {}


def _scorer(size: int, width: int, data: np.ndarray) -> Scorer:
    """The worker's scorer of a model, so that its tasks share what it remembers."""
    key = xxhash.xxh3_64_intdigest(data.tobytes())
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(Model(size, width, data))
    return _scorers[key]


def _score(shared_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, width, data = shared_b.value
        scorer = _scorer(vocabulary.size, width, data)
        for batch in c.slices(batches, "_text", 2 * c.SLICE_BYTES):
            two, one, word, within, offsets = contexts(batch.column("_text"), vocabulary)
            logs = (scorer.score(two, one, word) + within).astype(np.float32)
            n = np.diff(offsets)
            sums = np.concatenate([[0], np.cumsum(logs, dtype=np.float64)])
            total = sums[offsets[1:]] - sums[offsets[:-1]]
            missing = ~c.ints(batch.column("_text").is_valid())
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(logs), mask=pa.array(missing))
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = pa.array(total / n, mask=missing | (n == 0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int32), mask=missing), pa.array(total, mask=missing), mean, lists], ["doc_id", "n_tokens", "log_prob", "mean_log_prob", "token_log_probs"])

    return run


def score(df: DataFrame, vocabulary: Vocabulary, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, log_prob, mean_log_prob, token_log_probs)`` of every row, in natural logarithms."""
    shared_b = df.sparkSession.sparkContext.broadcast((vocabulary, model.width, model.data))
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens int, log_prob double, mean_log_prob double, token_log_probs array<float>"
    return rows.mapInArrow(_score(shared_b), schema)


def train_and_score(df: DataFrame, size: int = VOCABULARY, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on all of ``df`` and score all of it."""
    vocabulary, model = train(df.select(F.col(text_col).cast("string").alias("_text")), size, width)
    return score(df, vocabulary, model, id_col, text_col)
