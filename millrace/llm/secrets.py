"""Secret scans (operator 5): a battery of randomness tests with length-aware false-discovery control.

Candidates are all maximal runs of at least 16 characters of ``A-Z a-z 0-9 + / _ -``, with up to two ``=`` behind.  The
alphabet of each (hex, base32, letters, alphanumeric, base64 ...) is inferred from its characters,
and three tests ask whether its symbols look drawn at random from that alphabet: chi-squared
uniformity, runs about the middle of the alphabet, and serial correlation at lag 1.  The battery's
statistic comes from the sum of the logarithms of their p-values; near 0 means random.

A further runs test counts the changes from digits to letters and from small letters to capitals.
What ordinary text reaches by chance is simulated for every alphabet and length from the letter
pairs of the whole corpus, which gives each candidate a p-value under "ordinary text".  The
Benjamini-Hochberg procedure is applied within each class of lengths, from counts of p-values over
all distinct candidates (copies of a string are one test): short strings, on which the battery has little power, must be far more convincing
and do not profit from the discoveries among long ones.

Defined cases: null, empty and secret-free texts give no row; a text of any length is scanned whole;
repeated rows each give their rows; runs of digits alone are no candidates, as numbers and random
numbers cannot be told apart; offsets are 1-based and count characters.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import common as c

MIN_LENGTH, FDR = 16, 0.01
_RUN = rf"[A-Za-z0-9+/_\-]{{{MIN_LENGTH},}}={{0,2}}"
_ALPHABETS = {
    "hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz", "upper36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "alnum62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "wide": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
_SETS = {name: frozenset(a) for name, a in _ALPHABETS.items()}
_PLACES = {name: np.array([a.find(chr(i)) for i in range(128)]) for name, a in _ALPHABETS.items()}
_SIMULATED, _LONGEST = 3000, 1024
_LOG_P_STEP = 0.05


def encoding_of(s: str) -> str | None:
    """The narrowest alphabet that has all characters of ``s``; None for digits alone."""
    chars = frozenset(s.rstrip("="))
    if not chars or chars <= frozenset("0123456789"):
        return None
    return next((name for name in ("hex", "HEX", "lower", "upper", "base32", "letters", "lower36", "upper36", "alnum62", "base64", "base64url") if chars <= _SETS[name]), "wide")


def _normal_sf(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in np.atleast_1d(z)])


def _heavy_sf(t: float) -> float:
    """Upper tail of Student's t with 4 degrees of freedom: words are more varied than their letter pairs tell."""
    x = 1 + t * t / 4
    upper = 0.5 - 0.375 * t / math.sqrt(x) * (1 - t * t / (12 * x))
    return upper if t < 30 else 6 / t**4


def _uniformity(symbols: np.ndarray, k: int) -> np.ndarray:
    """Chi-squared over its degrees of freedom of each row."""
    m, n = symbols.shape
    counts = np.bincount((symbols + np.arange(m)[:, None] * k).ravel(), minlength=m * k).reshape(m, k)
    return ((counts - n / k) ** 2).sum(1) / (n / k) / (k - 1)


def _wilson_hilferty(ratio, df: int):
    return (ratio ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))


def battery(symbols: np.ndarray, k: int) -> np.ndarray:
    """p-values (chi-squared, runs, serial correlation) of each row of ``symbols``, numbers below ``k``; rows have one length."""
    m, n = symbols.shape
    z_chi = _wilson_hilferty(_uniformity(symbols, k), k - 1)
    high = symbols >= k // 2
    ones = high.sum(1)
    zeros = n - ones
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(1)
    both = 2.0 * ones * zeros
    mean, var = both / n + 1, np.maximum(both * (both - n) / (n * n * (n - 1.0)), 1e-12)
    z_runs = np.where(both > 0, np.abs(runs - mean) / np.sqrt(np.maximum(var, 0.25)), math.sqrt(n))
    centred = symbols - symbols.mean(1, keepdims=True)
    spread = (centred**2).sum(1)
    r = np.where(spread > 0, (centred[:, 1:] * centred[:, :-1]).sum(1) / np.maximum(spread, 1e-12), 1.0)
    z_serial = np.abs(r + 1 / n) * math.sqrt(n)
    return np.stack([_normal_sf(z_chi), np.minimum(2 * _normal_sf(z_runs), 1.0), np.minimum(2 * _normal_sf(z_serial), 1.0)], 1)


def _statistic(p: np.ndarray) -> np.ndarray:
    """Small for what isn't random; on a scale on which ordinary text is close to normal."""
    return -np.log1p(-np.log(np.maximum(p, 1e-300)).sum(1))


_FOLD = np.array([ord(chr(i).lower()) for i in range(128)])
_DIGIT_LETTER, _SMALL_CAPITAL = re.compile("[0-9][A-Za-z]"), re.compile("[a-z][A-Z]")
_RUN_CODES = sorted({ord(ch) for ch in _ALPHABETS["wide"].lower()})


def _log_tail(n: int, k: int, chance: float) -> float:
    """Logarithm of the chance of at least ``k`` successes in ``n``, for any ``n``: terms are relative to the first one."""
    if k <= n * chance:
        return 0.0 if k <= 0 else math.log1p(-min(math.exp(_log_tail(n, n - k + 1, 1 - chance)), 1 - 1e-16))
    first = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(chance) + (n - k) * math.log1p(-chance)
    total = term = 1.0
    for i in range(k, n):
        term *= (n - i) / (i + 1) * chance / (1 - chance)
        total += term
        if term < 1e-17 * total:
            break
    return min(0.0, first + math.log(total))


class OrdinaryText:
    """How likely strings that follow the corpus's letter pairs look random.

    Three things have to happen to ordinary text: that it stays within a narrow alphabet for the whole
    length, that it changes between digits, small letters and capitals as often, and that it then passes the battery.  Upper and lower case count as one for the former
    and in alphabets of one case, as whole words in capitals are ordinary too.
    """

    def __init__(self, pairs: np.ndarray) -> None:
        self._pairs = pairs.astype(np.float64)
        self._folded = np.zeros((128, 128))
        np.add.at(self._folded, (_FOLD[:, None], _FOLD[None, :]), self._pairs)

    @lru_cache(maxsize=None)
    def log_stay(self, encoding: str) -> float:
        """Logarithm of the chance that the next character of a run is in the alphabet too; 0 where all letters are."""
        at = sorted({ord(ch.lower()) for ch in _ALPHABETS[encoding]})
        if set(range(ord("a"), ord("z") + 1)) <= set(at):
            return 0.0
        rows = self._folded[at]
        return math.log((rows[:, at].sum() + 1) / (rows[:, _RUN_CODES].sum() + 1))

    @lru_cache(maxsize=None)
    def _switch(self, kind: str) -> float:
        """How often a digit is followed by a letter, or a small letter by a capital, among characters of runs."""
        digits, small, large = (list(map(ord, a)) for a in (_ALPHABETS["hex"][:10], _ALPHABETS["lower"], _ALPHABETS["upper"]))
        rows, to = (digits, small + large) if kind == "digit" else (small, large)
        return float((self._pairs[np.ix_(rows, to)].sum() + 1) / (self._pairs[rows].sum() + 2))

    def class_runs(self, s: str) -> float:
        """p-value of as many runs of digits before letters, and of small letters before capitals, in ordinary text."""
        p = 1.0
        for kind, n, k in (("digit", sum(map(str.isdigit, s)), len(_DIGIT_LETTER.findall(s))), ("case", sum(map(str.islower, s)), len(_SMALL_CAPITAL.findall(s)))):
            if k:
                p = min(p, math.exp(max(_log_tail(n, k, self._switch(kind)), -690.0)))
        return min(1.0, 2 * p)

    def expected(self, encoding: str, length: int) -> tuple[float, float]:
        """Mean and deviation of the statistic for any length.

        Lengths below 64 are simulated as they are, others at powers of 2 with straight lines between them.  Beyond
        the longest simulated strings chi-squared goes on with the length, as does what the other tests' logarithms have
        above those of random strings (1), until a p-value is at its floor; the deviation, which then only shrinks, is kept.
        """
        if length < 64:
            return self.fitted(encoding, length)[:2]
        if length >= _LONGEST:
            mean, deviation, logs, ratio = self.fitted(encoding, _LONGEST)
            df, times = len(_ALPHABETS[encoding]) - 1, length / _LONGEST
            longer = np.maximum(logs, 1 + (logs - 1) * times)
            here, there = (math.log(max(float(_normal_sf(_wilson_hilferty(x, df))[0]), 1e-300)) for x in (ratio, 1 + max(ratio - 1, 0.0) * times))
            longer[0] = logs[0] + max(here - there, 0.0)
            longer = np.minimum(longer, -math.log(1e-300))
            return mean + math.log1p(logs.sum()) - math.log1p(max(longer.sum(), logs.sum())), deviation
        low = 1 << (length.bit_length() - 1)
        part = math.log2(length / low)
        a, b = self.fitted(encoding, low), self.fitted(encoding, 2 * low)
        return a[0] + part * (b[0] - a[0]), a[1] + part * (b[1] - a[1])

    @lru_cache(maxsize=None)
    def fitted(self, encoding: str, length: int) -> tuple[float, float, np.ndarray, float]:
        """Over simulated strings mean and deviation of the statistic, the mean negative logarithm of each test's p-value, and mean chi-squared by degrees of freedom."""
        alphabet = _ALPHABETS[encoding]
        at = np.frombuffer(alphabet.encode(), np.uint8).astype(int)
        lower = _FOLD[at]
        folded = self._folded[np.ix_(lower, lower)]
        table = folded + 1e-3 if len(set(lower)) == len(at) else self._pairs[np.ix_(at, at)] + 1e-6 * folded + 1e-3
        start = np.cumsum(table.sum(1) / table.sum())
        steps = np.cumsum(table / table.sum(1, keepdims=True), 1)
        rng = np.random.default_rng([len(alphabet), length])
        u = rng.random((length, _SIMULATED))
        rows = np.empty((_SIMULATED, length), np.int64)
        state = np.minimum(np.searchsorted(start, u[0]), len(at) - 1)
        rows[:, 0] = state
        for i in range(1, length):
            state = np.minimum((steps[state] < u[i][:, None]).sum(1), len(at) - 1)
            rows[:, i] = state
        p = battery(rows, len(at))
        t = _statistic(p)
        return float(t.mean()), float(max(t.std(), 0.1)), -np.log(np.maximum(p, 1e-300)).mean(0), float(_uniformity(rows, len(at)).mean())

    def p_value(self, encoding: str, s: str, statistic: float) -> float:
        """Fisher's combination: ordinary text would stay in the alphabet, change classes as often, and look as random."""
        length = len(s)
        mean, deviation = self.expected(encoding, length)
        x = math.log(_heavy_sf((statistic - mean) / deviation)) + max((length - 1) * self.log_stay(encoding), -600.0) + math.log(max(self.class_runs(s), 1e-30))
        return min(1.0, max(math.exp(max(x, -690.0)) * (1 - x + x * x / 2), 1e-300))


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(128 * 128, np.int64)
    for batch in c.slices(batches, "_text"):
        texts = batch.column("_text").cast(pa.large_string())
        data = texts.buffers()[2]
        if data is None:
            continue
        ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        b = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
        plain = (b[:-1] < 128) & (b[1:] < 128)
        total += np.bincount((b[:-1].astype(np.int32) * 128 + b[1:])[plain], minlength=128 * 128)
    some = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["pair", "n"])


_FOUND = "_rid bigint, start int, length int, encoding string, chi2_p double, runs_p double, serial_p double, p_value double, string bigint"


def _candidates(pairs_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary, pattern = OrdinaryText(pairs_b.value), re.compile(_RUN)
        for batch in c.slices(batches, "_text"):
            texts = batch.column("_text")
            hit = np.nonzero(c.ints(pc.fill_null(pc.match_substring_regex(texts, _RUN), False)))[0]
            rows = []
            for rid, text in zip(batch.column("_rid").take(pa.array(hit)).to_pylist(), texts.take(pa.array(hit)).to_pylist()):
                for found in pattern.finditer(text):
                    s = found.group().strip("-_/=")
                    encoding = encoding_of(s)
                    if encoding is None or len(s) < MIN_LENGTH:
                        continue
                    p = battery(_PLACES[encoding][np.frombuffer(s.encode(), np.uint8)][None, :], len(_ALPHABETS[encoding]))
                    start = found.start() + found.group().index(s)
                    rows.append((rid, start + 1, len(s), encoding, *map(float, p[0]), ordinary.p_value(encoding, s, float(_statistic(p)[0])), xxhash.xxh3_64_intdigest(s) >> 1))
            if rows:
                names = ["_rid", "start", "length", "encoding", "chi2_p", "runs_p", "serial_p", "p_value", "string"]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), *[pa.float64()] * 4, pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)

    return run


def _length_class(length: Column) -> Column:
    """Two classes for every doubling."""
    return F.floor(F.log2(length) * 2).cast("int")


def find_secrets(rows: DataFrame, fdr: float = FDR) -> DataFrame:
    """Discoveries among ``rows (_rid, _text)``."""
    counted = rows.select("_text").mapInArrow(_pair_counts, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    pairs = np.zeros(128 * 128, np.int64)
    for r in counted:
        pairs[r["pair"]] = r["n"]
    pairs_b = rows.sparkSession.sparkContext.broadcast(pairs.reshape(128, 128))
    tested = c.stored(rows.select("_rid", "_text").mapInArrow(_candidates(pairs_b), _FOUND), "tested")
    tested = tested.withColumn("class", _length_class(F.col("length"))).withColumn("step", F.floor(F.log10("p_value") / _LOG_P_STEP).cast("int"))
    counts = tested.select("class", "step", "string").distinct().groupBy("class", "step").agg(F.count(F.lit(1)).alias("n"))  # at most 62 classes x 6,000 steps
    so_far = F.sum("n").over(Window.partitionBy("class").orderBy("step"))
    tests = F.sum("n").over(Window.partitionBy("class"))
    q = F.least(F.lit(1.0), F.pow(F.lit(10.0), (F.col("step") + 1) * _LOG_P_STEP) * tests / so_far)
    levels = counts.select("class", "step", q.alias("q")).select("class", "step", F.min("q").over(Window.partitionBy("class").orderBy(F.desc("step"))).alias("q_value"))
    return tested.join(F.broadcast(levels), ["class", "step"]).where(F.col("q_value") <= fdr).drop("class", "step", "string")


def scan(df: DataFrame, fdr: float = FDR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, start, length, encoding, chi2_p, runs_p, serial_p, p_value, q_value)`` of every secret; the secret itself is not repeated."""
    _, rows, unique = c.with_row_ids(df, id_col, text_col)
    found = find_secrets(rows, fdr)
    if unique:
        return found.withColumnRenamed("_rid", "doc_id")
    return rows.select("_rid", F.col("_id").alias("doc_id")).join(found, "_rid").drop("_rid")


def redact(df: DataFrame, mask: str = "[SECRET]", fdr: float = FDR, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``df`` with every secret replaced by ``mask``; where that changes a text, ``length_col`` (if there is one) is counted anew."""
    tagged, rows, _ = c.with_row_ids(df, id_col, text_col)
    spans = find_secrets(rows, fdr).groupBy("_rid").agg(F.sort_array(F.collect_list(F.struct("start", "length")), asc=False).alias("_spans"))
    spans = c.sized(c.stored(spans, "spans"), "_spans")
    text = c.place(df, text_col)
    clean = F.aggregate(
        "_spans", F.col(text).cast("string"),
        lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"] - 1), F.lit(mask), F.substring(t, s["start"] + s["length"], F.length(t))),
    )
    found = F.col("_spans").isNotNull()
    changed = tagged.join(spans, "_rid", "left").withColumn(text, F.when(found, clean).otherwise(F.col(text)))
    if length_col in df.columns:
        length = c.place(df, length_col)
        changed = changed.withColumn(length, F.when(found, F.length(text).cast(df.schema[length_col].dataType)).otherwise(F.col(length)))
    return c.restored(changed, df)
