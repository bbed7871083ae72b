"""The ten operators against brute force, on small tables with nulls, empty texts, repeats and clashing columns."""

import hashlib
import random
import zipfile
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import bpe_codec, exact_dedup, lm_scoring, media, ngram_join, packing, pretokens, secrets, suffix_dedup, token_counts, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def near(rng, text, share):
    return " ".join("changed" + str(rng.randrange(999)) if rng.random() < share else w for w in text.split(" "))


def texts(seed=1):
    """Unrelated texts, exact and near copies, a shared passage, long and short, empty and null ones."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(60, 200)) for _ in range(20)]
    passage = prose(rng, 70)
    out = [*base, base[0], base[0], base[1], near(rng, base[2], 0.03), near(rng, base[2], 0.03), near(rng, base[3], 0.1)]
    out += [base[4] + " " + passage + " " + prose(rng, 5), passage + " " + base[5], prose(rng, 30) + " " + passage.upper()]
    return out + ["", "", " \n ", "one", "One!", "one two", None, None, prose(rng, 30_000)]


def table(spark, values, extra=False, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", None if t is None else len(t)) for i, t in enumerate(values)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if extra:  # names that the operators use inside
        for name in ("_rid", "_id", "_text", "a", "b", "n", "key", "pos", "label", "group", "rank", "bin_id", "toxicity"):
            df = df.withColumn(name.upper() if name in ("_rid",) else name, df.lang)
    return df


def words(text):
    import regex

    return [] if text is None else regex.findall(r"[\p{L}\p{N}]+", text.lower())


# 1 media


def test_media_round_trip(spark):
    values = texts()
    rows = media.text_payloads(table(spark, values, extra=True)).collect()
    assert {(r.doc_id, r.text, r.n_bytes, r.sha256) for r in rows} == {
        (i, t, len(t.encode()), hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(values) if t is not None
    }
    assert all(r.error is None and r.attempts == 1 for r in rows)


def test_media_repeated_and_null_ids_and_empty_table(spark):
    rows = media.text_payloads(table(spark, ["x", "x", "y"], ids=[7, 7, None])).collect()
    assert sorted((str(r.doc_id), r.text) for r in rows) == [("7", "x"), ("7", "x"), ("None", "y")]
    assert media.text_payloads(table(spark, [])).count() == 0


def test_media_ids_that_look_like_names(spark):
    """Ids that end in a slash, hold NUL or look like the name of a null id come back as they were."""
    ids = ["a/", "b", "~null", "n", "", "x\0y", "50% é+", None]
    df = spark.createDataFrame([(i, f"text of {i}") for i in ids], "doc_id string, text string")
    assert {(r.doc_id, r.text) for r in media.text_payloads(df).collect()} == {(i, f"text of {i}") for i in ids}


def test_media_directory_is_tried_again(tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x", b"payload")
    calls, real = [], media._Seekable.seek

    def failing(self, *args):
        calls.append(1)
        if len(calls) == 1:
            raise OSError("lost")
        return real(self, *args)

    monkeypatch.setattr(media._Seekable, "seek", failing)
    reader = media.ArchiveReader({"path": str(tmp_path)})
    (batch,) = reader.read(reader.partitions()[0])
    assert batch.column("payload").to_pylist() == [b"payload"]


def test_media_ranges_and_damage(spark, tmp_path):
    payloads = {f"m{i}": bytes([i]) * (5000 + i) for i in range(40)} | {"pic": b"\x89PNG\r\n\x1a\n123", "empty": b""}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name, data in payloads.items():
            z.writestr(zipfile.ZipInfo(name), data)
    read = lambda: media.read_archives(spark, str(tmp_path), rangeBytes=30_000, retries=2)
    assert read().rdd.getNumPartitions() > 4
    assert {r.member: bytes(r.payload) for r in read().collect()} == payloads
    data = bytearray((tmp_path / "a.zip").read_bytes())
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        at = z.getinfo("m5").header_offset + 100
    data[at] ^= 255
    (tmp_path / "a.zip").write_bytes(data)
    rows = {r.member: r for r in read().collect()}
    assert rows["m5"].payload is None and rows["m5"].attempts == 2 and "checksum" in rows["m5"].error
    assert all(bytes(r.payload) == payloads[m] for m, r in rows.items() if m != "m5")
    (tmp_path / "b.zip").write_bytes(b"no archive")
    assert sum(r.error is not None for r in read().collect()) == 2
    assert rows["pic"].media_type == "image/png"


def test_media_second_try(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x", b"payload")
    reader = media.ArchiveReader({"path": str(tmp_path)})
    calls, real = [], media.read_member

    def failing(file, member):
        calls.append(1)
        if len(calls) == 1:
            raise OSError("lost")
        return real(file, member)

    media.read_member = failing
    try:
        (batch,) = reader.read(reader.partitions()[0])
    finally:
        media.read_member = real
    assert batch.column("attempts").to_pylist() == [2] and batch.column("payload").to_pylist() == [b"payload"]


# 2 packing


def best_fit(lengths, capacity):
    """One piece at a time: the fullest bin that has room, of equals the first opened."""
    space, out = [], []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, s in enumerate(space) if s >= n]
        if fits:
            i = min(fits, key=lambda i: (space[i], i))
        else:
            i = len(space)
            space.append(capacity)
        space[i] -= n
        out.append((n, i))
    return space, out


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 50, 100])
    lengths = [rng.randint(1, capacity) if rng.random() < 0.6 else rng.randint(1, 5) for _ in range(rng.randrange(1, 300))]
    histogram = defaultdict(int)
    for n in lengths:
        histogram[n] += 1
    filled, seen = defaultdict(int), defaultdict(int)
    for length, first, pieces, first_bin, per, offset in packing.plan(dict(histogram), capacity):
        assert seen[length] == first
        seen[length] += pieces
        for j in range(pieces):
            assert filled[first_bin + j // per] == offset + j % per * length
            filled[first_bin + j // per] += length
    assert seen == histogram and max(filled.values()) <= capacity
    space, _ = best_fit(lengths, capacity)
    assert sorted(filled.values()) == sorted(capacity - s for s in space)


def test_packing_takes_every_word_once(spark):
    values = texts()
    df = table(spark, values + values, extra=True, ids=[*range(len(values)), *range(len(values))])
    rows = packing.best_fit_pack(df, capacity=64).collect()
    per_doc, bins = defaultdict(int), defaultdict(list)
    for r in rows:
        per_doc[r.doc_id] += r.piece_length
        if r.bin_id is not None:
            bins[r.bin_id].append((r.bin_offset, r.piece_length))
    assert per_doc == {i: 2 * len((t or "").split()) for i, t in enumerate(values)}
    for pieces in bins.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 64
    lengths = [r.piece_length for r in rows if r.piece_length]
    assert len(bins) == len(best_fit(lengths, 64)[0])
    assert sum(r.bin_id is None for r in rows) == 2 * sum(not (t or "").split() for t in values)
    assert packing.best_fit_pack(table(spark, [])).count() == 0


def test_packing_given_lengths(spark):
    """Null and negative lengths occupy nothing and keep their row."""
    df = spark.createDataFrame([(1, 5), (2, -3), (3, None), (4, 0)], "doc_id bigint, n int")
    rows = {r.doc_id: (r.piece_length, r.bin_id) for r in packing.best_fit_pack(df, 8, length=df.n, text_col="n").collect()}
    assert rows == {1: (5, 0), 2: (0, None), 3: (0, None), 4: (0, None)}


# 3, 4 tokens

VOCABULARY = pretokens.DEFAULT_VOCABULARY


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pretokens.PATTERN, mergeable_ranks=pretokens.read_ranks(VOCABULARY), special_tokens={})


def odd_texts():
    rng = random.Random(3)
    letters = "ab cdeé ñ²½٣́\x1c\x1d \xa0 \n\t'sll日本!?_-0123"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)] + ["a" * 5000, " " * 3000, "ab" * 3000, "!" * 999]


def test_bpe_is_exact(spark, reference):
    values = texts() + odd_texts()
    df = table(spark, values, extra=True)
    rows = {r.doc_id: r for r in bpe_codec.encode(df).collect()}
    assert len(rows) == len(values)
    for i, t in enumerate(values):
        assert rows[i].token_ids == (None if t is None else reference.encode_ordinary(t))
        assert rows[i].round_trip is (None if t is None else True)
    back = {r.doc_id: r.text for r in bpe_codec.decode(bpe_codec.encode(df)).collect()}
    assert back == dict(enumerate(values))
    assert bpe_codec.encode(table(spark, [])).count() == 0


def test_token_counts_are_exact(spark, reference):
    values = texts() + odd_texts()
    rows = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(table(spark, values, extra=True)).collect()}
    assert rows == {i: None if t is None else len(reference.encode_ordinary(t)) for i, t in enumerate(values)}
    assert token_counts.count_tokens(table(spark, [])).count() == 0


def test_small_vocabulary_follows_merging():
    rng = random.Random(5)
    ranks = {bytes([b]): i for i, b in enumerate(b"abc")}
    for _ in range(40):
        made = rng.choice(list(ranks)) + rng.choice(list(ranks))
        ranks.setdefault(made, len(ranks))
    codec = bpe_codec.Codec(ranks)
    for _ in range(300):
        data = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 40)))
        parts = [data[i : i + 1] for i in range(len(data))]
        while True:
            at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 30), default=-1)
            if at < 0 or parts[at] + parts[at + 1] not in ranks:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        assert codec.encode_bytes(data) == tuple(ranks[p] for p in parts)
        assert token_counts.merged_length(data, ranks) == len(parts)


# 5 secrets


def test_secrets_found_and_words_left_alone(spark):
    rng = random.Random(2)
    values, hidden = [], {}
    for i in range(120):
        t = prose(rng, 80) + " thereintothewhereuponandnotwithstanding"
        if i % 4 == 0:
            kind = i % 12
            s = "".join(rng.choice({0: "0123456789abcdef", 4: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}.get(kind, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")) for _ in range(40))
            hidden[i] = s
            t = t[:100] + " key=" + s + " é " + t[100:]
        values.append(t)
    values += [None, "", "1234567890123456789012345"]
    df = table(spark, values, extra=True)
    found = defaultdict(list)
    for r in secrets.scan(df).collect():
        found[r.doc_id].append(values[r.doc_id][r.start - 1 : r.start - 1 + r.length])
    assert set(found) == set(hidden)
    clean = {r.doc_id: r for r in secrets.redact(df).collect()}
    assert len(clean) == len(values)
    for i, t in enumerate(values):
        if i in hidden:
            assert found[i] in ([hidden[i]], ["key=" + hidden[i]]) or hidden[i].strip("/+") in found[i][0]
            assert hidden[i] not in clean[i].text and "[SECRET]" in clean[i].text and clean[i].n_chars == len(clean[i].text)
        else:
            assert clean[i].text == t
    assert secrets.scan(table(spark, [])).count() == 0
    assert secrets.redact(table(spark, [])).count() == 0


def test_battery_is_uniform_on_random_symbols():
    p = secrets.battery(np.random.default_rng(1).integers(0, 16, (4000, 64)), 16)
    assert abs((p[:, 0] < 0.1).mean() - 0.1) < 0.03
    assert abs((p[:, 2] < 0.1).mean() - 0.1) < 0.03


def test_class_runs_count_at_every_length(spark):
    import math

    for n, k, chance in [(40, 9, 0.05), (300, 2, 0.01), (499, 30, 0.02), (100, 90, 0.3)]:
        exact = sum(math.comb(n, i) * chance**i * (1 - chance) ** (n - i) for i in range(k, n + 1))
        assert math.exp(secrets._log_tail(n, k, chance)) == pytest.approx(exact, rel=1e-9)
    rng = random.Random(14)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    values = [prose(rng, 50) + " " + "".join(rng.choice(WORDS) for _ in range(rng.randrange(80, 1000))) for _ in range(300)]
    pairs = np.zeros((128, 128), np.int64)
    for t in values:
        np.add.at(pairs, (np.frombuffer(t[:-1].encode(), np.uint8), np.frombuffer(t[1:].encode(), np.uint8)), 1)
    secret = "".join(rng.choice(letters) for _ in range(5000))
    assert secrets.OrdinaryText(pairs).class_runs(secret) < 1e-30
    assert secrets.OrdinaryText(pairs).class_runs(values[0]) == 1.0
    assert {r.doc_id for r in secrets.scan(table(spark, [*values, "key " + secret])).collect()} == {300}


def naive_battery(symbols, k):
    """The three p-values, one symbol at a time."""
    import math

    n = len(symbols)
    chi = sum((symbols.count(x) - n / k) ** 2 / (n / k) for x in range(k))
    df = k - 1
    z = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    high = [x >= k // 2 for x in symbols]
    ones, zeros = sum(high), n - sum(high)
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    both = 2 * ones * zeros
    z_runs = abs(runs - both / n - 1) / math.sqrt(max(both * (both - n) / (n * n * (n - 1)), 0.25)) if both else math.sqrt(n)
    mean = sum(symbols) / n
    spread = sum((x - mean) ** 2 for x in symbols)
    r = sum((a - mean) * (b - mean) for a, b in zip(symbols, symbols[1:])) / spread if spread else 1.0
    return tail(z), min(1, 2 * tail(z_runs)), min(1, 2 * tail(abs(r + 1 / n) * math.sqrt(n)))


def test_scan_against_brute_force(spark):
    """Every candidate tested naively, then Benjamini-Hochberg by length class over distinct strings; ids repeat, one text is very long."""
    import math
    import re

    rng = random.Random(31)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    values = []
    for i in range(150):
        t = prose(rng, 30) + " " + "".join(rng.choice(WORDS) for _ in range(rng.randrange(3, 12)))
        if i % 10 == 0:
            t += " " + "".join(rng.choice(letters if i % 20 else "0123456789abcdef") for _ in range(rng.randrange(18, 60)))
        values.append(t)
    values += [values[0], prose(rng, 20_000) + " " + "".join(rng.choice(letters) for _ in range(3000)), None, ""]
    ids = [7 if i < 3 else i for i in range(len(values))]
    pairs = np.zeros((128, 128), np.int64)
    for t in values:
        for a, b in zip(t or "", (t or "")[1:]):
            pairs[ord(a), ord(b)] += 1
    ordinary = secrets.OrdinaryText(pairs)
    tests, where = {}, []
    for i, t in zip(ids, values):
        for m in re.finditer(r"[A-Za-z0-9+/_\-]{16,}={0,2}", t or ""):
            s = m.group().strip("-_/=")
            kind = secrets.encoding_of(s)
            if kind is None or len(s) < 16:
                continue
            alphabet = secrets._ALPHABETS[kind]
            p = naive_battery([alphabet.index(x) for x in s], len(alphabet))
            assert secrets.battery(np.array([[alphabet.index(x) for x in s]]), len(alphabet))[0] == pytest.approx(p, rel=1e-6, abs=1e-12)
            value = ordinary.p_value(kind, s, -math.log1p(-sum(math.log(max(x, 1e-300)) for x in p)))
            step = math.floor(math.log10(value) / 0.05)
            tests[s] = math.floor(math.log2(len(s)) * 2), 10 ** ((step + 1) * 0.05)
            where.append((i, m.start() + m.group().index(s) + 1, len(s), s))
    found = set()
    for k in {x for x, _ in tests.values()}:
        ps = sorted((p, s) for s, (x, p) in tests.items() if x == k)
        passed = [j for j, (p, _) in enumerate(ps, 1) if p * len(ps) / j <= 0.01 * (1 + 1e-9)]
        limit = ps[passed[-1] - 1][0] if passed else 0
        found |= {s for p, s in ps if p <= limit * (1 + 1e-9)}
    rows = secrets.scan(table(spark, values, ids=ids)).collect()
    assert sorted((r.doc_id, r.start, r.length) for r in rows) == sorted((i, a, n) for i, a, n, s in where if s in found)
    assert len(found) >= 15


def test_ordinary_text_is_expected_at_every_length():
    """No length is taken for another: the mean of long ordinary strings goes on as their simulation does."""
    pairs = np.zeros((128, 128), np.int64)
    pairs[97:123, 97:123] = 10_000 // np.arange(1, 27) ** 2
    ordinary = secrets.OrdinaryText(pairs)
    means = [ordinary.expected("lower", n)[0] for n in (63, 64, 90, 128, 700, 1023, 1024, 5000, 10**6, 10**8)]
    assert all(b < a + 0.01 for a, b in zip(means, means[1:])) and means[-1] < means[0] - 1
    assert ordinary.expected("lower", 1023)[0] == pytest.approx(ordinary.expected("lower", 1024)[0], abs=0.01)
    assert ordinary.expected("lower", 3000)[0] == pytest.approx(ordinary.fitted("lower", 3000)[0], abs=0.1)
    pairs[97:123, 97:123] = 10_000 + 300 * np.arange(26)
    flat = secrets.OrdinaryText(pairs)
    assert flat.expected("lower", 3000)[0] == pytest.approx(flat.fitted("lower", 3000)[0], abs=0.2)


# 6 n-gram join


def gram_set(text, n):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


@pytest.mark.parametrize(("n", "theta"), [(2, 0.65), (1, 0.5), (3, 0.3), (2, 1.0)])
def test_jaccard_join_is_exact(spark, n, theta):
    values = texts() + family(20)
    sets = [gram_set(t, n) for t in values]
    first = {}
    expected = {}
    for i, s in enumerate(sets):
        if s and first.setdefault(s, i) != i:
            expected[first[s], i] = 1.0
    for (s, i), (u, j) in combinations(first.items(), 2):
        score = len(s & u) / len(s | u)
        if score >= theta:
            expected[min(i, j), max(i, j)] = score
    rows = ngram_join.near_pairs(table(spark, values, extra=True), n=n, theta=theta).collect()
    assert {(r.doc_a, r.doc_b): pytest.approx(r.jaccard) for r in rows} == expected
    assert len(rows) == len(expected)


def family(k, seed=21, share=0.16):
    """Near copies of one text, some of which may be too far from each other, and copies of copies."""
    rng = random.Random(seed)
    base = prose(rng, 120)
    made = [near(rng, base, rng.random() * share) for _ in range(k)]
    return made + made[: k // 5]


@pytest.mark.parametrize(("n", "theta"), [(2, 0.65), (1, 0.5)])
def test_classes_and_links_are_exact(spark, n, theta):
    values = texts() + family(60) + family(30, 22)
    sets = [gram_set(t, n) for t in values]
    links, label = defaultdict(int), list(range(len(values)))
    for i, j in combinations(range(len(values)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= theta:
            links[i] += 1
            links[j] += 1
            if label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    rows = ngram_join.near_classes(table(spark, values, extra=True), n=n, theta=theta).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in rows) == [(i, x, links[i]) for i, x in enumerate(label)]
    assert max(links.values()) > 30


def test_pairs_of_a_cell_are_not_made(spark):
    """Near copies of one text end up in one cell, so that hardly any pair of them has to be compared."""
    df = table(spark, family(80, share=0.06))
    _, _, _, classes, _, placed, found = ngram_join._near(df, 2, 0.65, "doc_id", "text")
    _, _, _, _, _, _, every = ngram_join._near(df, 2, 0.65, "doc_id", "text", pivots=False)
    assert placed.count() > 0.7 * classes.count()
    assert found.count() < 0.5 * every.count()


def test_large_families_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PAIRS_PER_TASK", 50)
    values = family(40)
    sets = [gram_set(t, 2) for t in dict.fromkeys(values)]
    expected = sum(len(a & b) / len(a | b) >= 0.65 for a, b in combinations(sets, 2))
    rows = ngram_join.near_pairs(table(spark, list(dict.fromkeys(values))), n=2, theta=0.65)
    assert rows.count() == rows.select("doc_a", "doc_b").distinct().count() == expected


def test_a_large_cluster_is_counted_in_family_blocks(spark, monkeypatch):
    """Most links of two clusters are found inside of blocks; strips and grams put last lose none and count none twice."""
    made, links = [], getattr(ngram_join, "family_links", None)
    monkeypatch.setattr(ngram_join, "family_links", lambda *x: made.append(links(*x)) or made[-1], raising=False)
    monkeypatch.setattr(ngram_join, "FAMILY_LEAST", 4, raising=False)
    monkeypatch.setattr(ngram_join, "STRIP_SETS", 25, raising=False)
    monkeypatch.setattr(ngram_join, "HOT_SAMPLE", 1, raising=False)
    values = family(60, share=0.3) + family(40, 22, share=0.3) + texts()
    sets = [gram_set(t, 2) for t in values]
    near_to = [{j for j, b in enumerate(sets) if i != j and a and b and len(a & b) / len(a | b) >= 0.65} for i, a in enumerate(sets)]
    least = list(range(len(sets)))
    for _ in sets:
        least = [min([least[i], *(least[j] for j in near_to[i])]) for i in range(len(sets))]
    rows = sorted(tuple(r) for r in ngram_join.near_classes(table(spark, values)).collect())
    assert rows == [(i, least[i], len(x)) for i, x in enumerate(near_to)]
    assert made and sum(r.n for r in made[0].collect()) > 0.4 * sum(map(len, near_to))


def test_windows_of_document_pivots_replicate(spark):
    assert ngram_join.window_share(table(spark, texts()), pivots=8).first().mean_share > 0.5


@pytest.mark.parametrize("held", [20, 300, 10**6])
def test_no_pair_is_lost_in_the_regions(monkeypatch, held):
    """The counts of several tasks, in one part or in many, let every near pair through."""
    from millrace.llm import common

    monkeypatch.setattr(ngram_join, "HELD_PAIRS", held)
    rng = np.random.default_rng(3)
    tasks, theta, sets = 5, 0.65, []
    for _ in range(25):
        base = rng.integers(1, 10**6, rng.integers(3, 120)).astype(np.uint64)
        for _ in range(rng.integers(1, 6)):
            kept = base[rng.random(len(base)) > 0.12]
            sets.append(np.unique(np.concatenate([kept, rng.integers(1, 10**6, rng.integers(0, 8)).astype(np.uint64)])))
    heads = np.zeros(len(sets), ngram_join._HEAD)
    rows = []
    for i, s in enumerate(sets):
        heads[i] = 1000 + i, 1000 + i, len(s), 0
        rows += [(k, i) for k in s[: int(ngram_join.window_size(len(s), theta))].tolist()]
    met, need, told = defaultdict(int), {}, defaultdict(int)
    for task in range(tasks):
        mine = [r for r in rows if int(common.mix(np.array([r[0]], np.uint64))[0]) % tasks == task]
        e = np.zeros(len(mine), ngram_join._ENTRY)
        e["low"] = [k for k, _ in mine]
        for a, b, n, least, last in ngram_join.region_pairs(heads, e, np.array([i for _, i in mine]), theta, tasks):
            for x in zip(a.tolist(), b.tolist(), n.tolist(), least.tolist(), last.tolist()):
                met[x[:2]] += x[2]
                need[x[:2]] = x[3]
                told[x[:2]] += x[4]
    found = {p for p in met if met[p] + (tasks - told[p]) * need[p] / (2 * tasks) >= need[p] - 1e-6}
    near = {(1000 + i, 1000 + j) for i, j in combinations(range(len(sets)), 2) if len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= theta}
    assert len(near) > 20 and near <= found


def allocated(run) -> float:
    """MB that ``run`` has in use at most, numpy's arrays among them."""
    import tracemalloc

    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_grams_are_made_of_a_part_of_the_text_at_once():
    rng = np.random.default_rng(5)
    values = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 50_000, 400)) for _ in range(1500)] + [None, ""])
    assert allocated(lambda: sum(len(g) for g in ngram_join.gram_keys(values, 2))) < 25
    alone = [g for i in range(len(values)) for g in ngram_join.gram_keys(values.slice(i, 1), 2)]
    assert all(np.array_equal(x, y) for x, y in zip(ngram_join.gram_keys(values, 2), alone, strict=True))


def test_grams_meet_a_sieve_that_is_made_once(monkeypatch):
    texts = pa.array([f"w{i} w{i + 1} w{i + 2} w{i % 7}" for i in range(400)])
    levels = np.ones(1 << ngram_join.PLACE_BITS, np.uint8)
    grams = np.unique(np.concatenate(list(ngram_join.gram_keys(texts, 2, levels)))) & np.uint64((1 << 41) - 1)
    hot = np.sort(grams[::3]), np.full(len(grams[::3]), 70, np.uint8)
    want = list(ngram_join.gram_keys(texts, 2, levels, hot))
    sieve = ngram_join.sieved(hot[0])
    assert sieve[hot[0] & ngram_join._SIEVE].all() and 8 * ngram_join.HOT_MOST <= len(sieve)  # a sieve of 2**21 places let most grams through
    monkeypatch.setattr(ngram_join, "sieved", None)
    assert all(np.array_equal(x, y) for x, y in zip(ngram_join.gram_keys(texts, 2, levels, (*hot, sieve)), want, strict=True))
    assert {int(k >> np.uint64(41)) for g in want for k in g} == {1, 70}


def test_pairs_of_regions_are_passed_on_a_few_at_once():
    """A million chance meetings: each pair is told once, with all its meetings."""
    docs, regions = 3000, 6
    heads = np.zeros(docs, ngram_join._HEAD)
    heads["rid"] = heads["cell"] = np.arange(docs)
    heads["size"] = 50
    owner = np.tile(np.arange(docs, dtype=np.int32), regions)
    entries = np.zeros(len(owner), ngram_join._ENTRY)
    entries["low"] = owner % 20 * regions + np.repeat(np.arange(regions), docs)
    sizes, met = [], 0

    def run():
        nonlocal met
        for part in ngram_join.region_pairs(heads, entries, owner, 0.65, 100):
            sizes.append(len(part[0]))
            met += int(part[2].sum())

    assert allocated(run) < 40
    pairs = 20 * (docs // 20) * (docs // 20 - 1) // 2
    assert (sum(sizes), met) == (pairs, pairs * regions) and max(sizes) <= 200_000


def test_word_levels_count_all_tasks(spark):
    rows = spark.createDataFrame([(" ".join(["often"] * 3 + [f"once{i}"]),) for i in range(40)], "_text string").repartition(9)
    levels = ngram_join.word_levels(rows)
    from millrace.llm import common

    often, once = (levels[ngram_join._place(common.hash_words(pa.array([w])))][0] for w in ("often", "once7"))
    assert (often, once) == (round(2 * np.log2(120)), 0)


@pytest.mark.parametrize("query", ["join", "packing"])
def test_no_second_kind_of_python_workers(spark, monkeypatch, query):
    """A list given to createDataFrame goes through Python workers of its own, which stay beside the others."""
    docs, made = table(spark, texts()[:6]), []
    kept = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *rest, **more: made.append(type(data)) or kept(self, data, *rest, **more))
    (ngram_join.drop_near_copies(docs) if query == "join" else packing.best_fit_pack(docs)).count()
    assert list not in made


def test_jaccard_join_cases(spark):
    assert ngram_join.near_classes(table(spark, [])).count() == 0
    rows = ngram_join.near_classes(table(spark, ["p q r", "p q r", "x", "x", "y"], ids=[5, 5, 4, None, None])).collect()
    assert sorted(map(tuple, rows), key=str) == [(4, 4, 1), (5, 5, 1), (5, 5, 1), (None, 4, 1), (None, None, 0)]
    assert [tuple(r) for r in ngram_join.near_pairs(table(spark, ["p q r", "p q r"], ids=[5, None])).collect()] == [(5, None, 1.0)]


def test_one_of_each_group_stays(spark):
    values = texts()
    sets = [gram_set(t, 2) for t in values]
    label = list(range(len(values)))
    for _ in values:
        for i, j in combinations(range(len(values)), 2):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.65:
                label[i] = label[j] = min(label[i], label[j])
    kept = ngram_join.drop_near_copies(table(spark, values))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, x in enumerate(label) if x == i]
    assert ngram_join.drop_near_copies(table(spark, ["p q r", "p q r"], ids=[5, 5])).count() == 1


# 7 language model


def test_lm_is_normalised_and_learns(spark):
    rng = random.Random(4)
    nexts = {w: rng.sample(WORDS, 2) for w in WORDS}
    values = []
    for _ in range(400):
        w = rng.choice(WORDS)
        out = [w]
        for _ in range(100):
            w = rng.choice(nexts[w])
            out.append(w)
        values.append(" ".join(out))
    df = table(spark, [*values, None, "", "unseen"], extra=True)
    vocabulary, model = lm_scoring.train(df.select(df.text.alias("_text")), size=64, width=8)
    scorer = lm_scoring.Scorer(model)
    for two, one in [(0, 1), (5, 7), (1, 1)]:
        n = model.size
        p = np.exp(scorer.score(np.full(n, two), np.full(n, one), np.arange(n)))
        assert p.sum() == pytest.approx(1, abs=1e-3)
    rows = {r.doc_id: r for r in lm_scoring.score(df, vocabulary, model).collect()}
    held = [rows[i].mean_log_prob for i in range(400)]
    share = np.array([sum(t.split().count(w) for t in values) for w in WORDS])
    entropy = -(share / share.sum() * np.log(share / share.sum())).sum()
    assert -np.mean(held) < entropy - 0.3  # better than counting words
    assert rows[0].n_tokens == 101 and len(rows[0].token_log_probs) == 101 and rows[0].log_prob == pytest.approx(sum(rows[0].token_log_probs), rel=1e-4)
    assert rows[400].n_tokens is None and rows[400].token_log_probs is None
    assert rows[401].n_tokens == 0 and rows[401].mean_log_prob is None and rows[401].token_log_probs == []
    assert lm_scoring.train_and_score(table(spark, [])).count() == 0


def test_lm_tells_all_words_apart(spark):
    """A corpus of many more words than are classes by themselves: every word has a probability of its own, and they sum to 1."""
    rng = random.Random(9)
    names = [w + x for w in WORDS for x in ("", "a", "bo", "cide", "duration", "elli", "f7", "gg", "hh", "ii", "jj", "kk")]
    weights = [1 / (i + 1) for i in range(len(names))]
    values = [" ".join(rng.choices(names, weights, k=60)) for _ in range(100)] + ["once" + str(i) for i in range(20)]
    count = defaultdict(int)
    for w in " ".join(values).split():
        count[w] += 1
    vocabulary, model = lm_scoring.train(table(spark, values).selectExpr("text as _text"), size=16, width=4)
    assert len(count) > 10 * 16 and model.size < len(count)
    every = sorted(count)
    found = [r.log_prob for r in sorted(lm_scoring.score(table(spark, every), vocabulary, model).collect(), key=lambda r: r.doc_id)]
    assert sum(np.exp(found)) == pytest.approx(1, abs=0.02)
    p = dict(zip(every, np.exp(found)))
    common = sorted(count, key=count.get)[-5:]
    assert max(p[w] for w in count if count[w] == 1) < min(p[w] for w in common)
    pairs = [(a, b) for a, b in combinations(every, 2) if vocabulary.find(pa.array([a]))[0] == vocabulary.find(pa.array([b]))[0]]
    assert pairs and all(p[a] / p[b] == pytest.approx(count[a] / count[b], rel=1e-3) for a, b in pairs)


@pytest.mark.parametrize("listed", [2_000_000, 60])
def test_lm_scores_against_a_naive_softmax(spark, monkeypatch, listed):
    """Every word's score from the parameters, one exponential at a time; also where the table of words is cut to a size."""
    import math

    monkeypatch.setattr(lm_scoring, "LISTED", listed)
    rng = random.Random(19)
    names = [f"{w}{x}" for w in WORDS for x in range(12)]
    values = [" ".join(rng.choices(names, [1 / (i + 1) for i in range(len(names))], k=rng.randrange(1, 40))) for _ in range(40)] + ["alpha0 unseen", None, ""]
    count = defaultdict(int)
    for w in " ".join(v for v in values if v).split():
        count[w] += 1
    vocabulary, m = lm_scoring.train(table(spark, values).selectExpr("text as _text"), size=16, width=4)
    rows = {r.doc_id: r.token_log_probs for r in lm_scoring.score(table(spark, values), vocabulary, m).collect()}
    classes = {w: int(vocabulary.find(pa.array([w]))[0][0]) for w in count}
    total = defaultdict(int)
    for w, n in count.items():
        total[classes[w]] += n
    within = {w: math.exp(vocabulary.find(pa.array([w]))[1][0]) for w in count}
    if listed > len(count):
        assert within == pytest.approx({w: n / total[classes[w]] for w, n in count.items()}, rel=1e-5)
    for k in total:
        assert sum(within[w] for w in count if classes[w] == k) == pytest.approx(1, rel=1e-5)
    for i, t in enumerate(values):
        before = [1, 1]
        for w, score in zip((t or "").split(), rows[i] or []):
            q = [float(x + y) for x, y in zip(m.two[before[-2]], m.one[before[-1]])]
            s = [sum(x * float(y) for x, y in zip(q, v)) + float(b) for v, b in zip(m.target, m.bias)]
            assert score == pytest.approx(s[classes[w]] - math.log(sum(map(math.exp, s))) + math.log(within[w]), abs=1e-3)
            before = [before[-1], int(vocabulary.context[classes[w]])]


# 8 repeated passages


def brute_passages(values, k):
    where = defaultdict(list)
    for i, t in enumerate(values):
        w = words(t)
        for p in range(len(w) - k + 1):
            where[tuple(w[p : p + k])].append((i, p))
    hits = {x: min(v) for v in where.values() for x in v if min(v)[0] != x[0]}
    out = []
    for (i, p), (j, q) in sorted(hits.items()):
        if out and out[-1][0] == i and out[-1][1] + out[-1][2] - k + 1 == p and out[-1][3] == j and out[-1][4] - out[-1][1] == q - p:
            out[-1][2] += 1
        else:
            out.append([i, p, k, j, q])
    return sorted(map(tuple, out))


@pytest.mark.parametrize(("k", "key", "hot"), [(50, 18, 100_000), (20, 8, 2), (3, 3, 1)])
def test_passages_are_exact(spark, k, key, hot):
    """Also where what many documents share is aggregated before the shuffle."""
    values = texts()
    rows = suffix_dedup.repeated_passages(table(spark, values, extra=True), min_words=k, key_words=key, hot=hot).collect()
    assert sorted((r.doc_id, r.start, r.n_words, r.source_id, r.source_start) for r in rows) == brute_passages(values, k)


def test_passages_in_batches(spark, tmp_path):
    index = suffix_dedup.SuffixIndex(spark)
    rng = random.Random(8)
    t = prose(rng, 90)
    brought = []
    for i in range(5):
        rows = spark.createDataFrame([(i, (t if i in (1, 4) else prose(rng, 90)))], "_rid bigint, _text string")
        brought.append(index.add(index.suffixes(rows)).count())
    assert [n > 0 for n in brought] == [False, False, False, False, True]
    assert sorted(index.levels) == [0, 2]
    index.save(str(tmp_path / "family"))
    again = suffix_dedup.SuffixIndex.load(spark, str(tmp_path / "family"))
    rows = spark.createDataFrame([(9, t), (10, prose(rng, 90))], "_rid bigint, _text string")
    assert again.add(again.suffixes(rows)).count() == brought[4] and sorted(again.levels) == [1, 2]
    again.save(str(tmp_path / "family"))
    assert sorted(suffix_dedup.SuffixIndex.load(spark, str(tmp_path / "family")).levels) == [1, 2]
    assert suffix_dedup.repeated_passages(table(spark, [])).count() == 0


def test_passages_do_not_shuffle_texts(spark):
    """However many keys are shared: texts are read again, and what moves is packed by anchor."""
    values = texts()
    plan = suffix_dedup.repeated_passages(table(spark, values).repartition(3).localCheckpoint())._jdf.queryExecution().executedPlan().toString()
    assert "_text" in plan and "Join" not in plan


def test_passages_across_batches_of_one_anchor(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        values = texts(3)
        rows = suffix_dedup.repeated_passages(table(spark, values), min_words=20, key_words=3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.doc_id, r.start, r.n_words, r.source_id, r.source_start) for r in rows) == brute_passages(values, 20)


# 9 exact copies


def test_exact_copies(spark):
    values = [*texts(), "x" * 70_000, "x" * 70_000, "x" * 70_001, "y" * 64, "y" * 64, "y" * 65]
    first, expected = {}, []
    for i, t in enumerate(values):
        if t is not None and first.setdefault(t, i) != i:
            expected.append((i, first[t]))
    df = table(spark, values, extra=True)
    assert sorted((r.doc_id, r.kept_id) for r in exact_dedup.exact_copies(df).collect()) == expected
    kept = exact_dedup.drop_exact_copies(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(range(len(values))) - {i for i, _ in expected})


def test_exact_copies_with_repeated_ids(spark):
    df = table(spark, ["a", "a", "b", None, None], ids=[1, 1, 1, 2, None])
    assert [(r.doc_id, r.kept_id) for r in exact_dedup.exact_copies(df).collect()] == [(1, 1)]
    assert sorted(str(r.text) for r in exact_dedup.drop_exact_copies(df).collect()) == ["None", "None", "a", "b"]
    assert exact_dedup.exact_copies(table(spark, [])).count() == 0


def test_columns_with_inner_names_survive(spark):
    from pyspark.sql import functions as F

    df = table(spark, ["a b c", "a b c", None]).withColumn("_rid", F.lit(77)).withColumn("c0", F.lit("x")).withColumn("_Spans", F.lit(1.5))
    for out in (exact_dedup.drop_exact_copies(df), ngram_join.drop_near_copies(df), secrets.redact(df)):
        assert out.columns == df.columns
        assert {(r["_rid"], r["c0"], r["_Spans"]) for r in out.collect()} == {(77, "x", 1.5)}


def test_ids_that_are_text(spark):
    df = table(spark, ["p q r", "p q r"]).selectExpr("concat('id', doc_id) as doc_id", "text")
    assert [tuple(r) for r in exact_dedup.exact_copies(df).collect()] == [("id1", "id0")]
    long = " ".join(f"w{i}" for i in range(80))
    assert [(r.doc_a, r.doc_b) for r in ngram_join.near_pairs(df).collect()] == [("id0", "id1")]
    df = spark.createDataFrame([("z", long), ("a", long), ("m", "x " + long), (None, long)], "doc_id string, text string")
    for parts in (1, 3):
        assert set(map(tuple, exact_dedup.exact_copies(df.repartition(parts)).collect())) == {(None, "a"), ("z", "a")}
        assert {r.source_id for r in suffix_dedup.repeated_passages(df.repartition(parts)).collect()} == {"a"}


# 10 toxicity


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(6)
    values = [prose(rng, rng.randrange(20, 300)) for _ in range(600)]
    toxic = [i % 5 == 0 for i in range(600)]
    for i in range(0, 600, 5):
        at = values[i].split(" ")
        for _ in range(3):
            at.insert(rng.randrange(len(at)), rng.choice(["rotten", "vermin", "scum"]))
        values[i] = " ".join(at)
    df = table(spark, [*values, None, "", prose(rng, 20_000)], extra=True)
    labels = spark.createDataFrame([(i, 1, int(toxic[i])) for i in range(400)] + [(3, 1, None), (None, 1, 1), (99_999, 0, 1)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(df, labels)
    assert 0 < len(model[0]) < 5000
    rows = {r.doc_id: r.is_toxic for r in toxicity.score(df, model).collect()}
    assert np.mean([rows[i] == toxic[i] for i in range(400, 600)]) > 0.97
    assert rows[600] is False and rows[601] is False and len(rows) == 603
    kept = toxicity.drop_toxic(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, x in rows.items() if not x}
    none = toxicity.fit(df, labels.limit(0))
    assert not any(r.is_toxic for r in toxicity.score(df, none).collect())
    assert toxicity.score(table(spark, []), model).count() == 0


def test_training_against_a_naive_one():
    """FTRL-proximal one coordinate at a time, in the same order."""
    import math

    rng = np.random.default_rng(8)
    examples = [np.unique(rng.integers(0, 300, rng.integers(1, 40))) for _ in range(80)]
    labels = np.array([float(17 in e or 4 in e) for e in examples])
    places, weights, bias = toxicity.train(examples, labels, passes=3)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        shrink = 0 if i == "bias" else toxicity.L1
        if abs(z[i]) <= shrink:
            return 0.0
        return -(z[i] - math.copysign(shrink, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    order = np.random.default_rng(7)
    for _ in range(3):
        for e in order.permutation(len(examples)):
            at = [*examples[e].tolist(), "bias"]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - labels[e]
            for i in at:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w[i]
                n[i] += g * g
    naive = {i: weight(i) for i in z if i != "bias" and weight(i)}
    assert dict(zip(places.tolist(), weights)) == pytest.approx(naive, rel=1e-6)
    assert bias == pytest.approx(weight("bias"), rel=1e-6)


def test_training_does_not_depend_on_partitions(spark):
    df = table(spark, texts())
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, toxic int")
    a, b = toxicity.fit(df, labels), toxicity.fit(df.repartition(7), labels.repartition(5))
    assert all(np.array_equal(x, y) for x, y in zip(a, b))


def test_words_as_defined():
    from millrace.llm import common

    values = texts() + odd_texts()[:300]
    codes, offsets, vocabulary = common.split_words(pa.array(values, pa.string()))
    got = [[vocabulary[x].as_py() for x in codes[a:b]] for a, b in zip(offsets[:-1], offsets[1:])]
    assert got == [words(t) for t in values]
    assert len(set(common.hash_words(vocabulary).tolist())) == len(vocabulary)


def test_toxicity_takes_little_memory_at_once():
    import tracemalloc

    rng = random.Random(10)
    text = pa.array([prose(rng, 500) for _ in range(1_500)])  # one batch of 5 MB
    assert text.nbytes > 5_000_000
    weights_b = type("Broadcast", (), {"value": (np.arange(50), np.ones(50), -1.0)})
    batches = {
        "examples": (toxicity._example_rows, pa.RecordBatch.from_arrays([pa.array([1] * len(text), pa.int32()), text], ["toxic", "_text"])),
        "scores": (toxicity._scores(weights_b, "c1"), pa.RecordBatch.from_arrays([pa.array(range(len(text))), text], ["c0", "c1"])),
    }
    for name, (run, batch) in batches.items():
        tracemalloc.start()
        rows = [(b.num_rows, b.schema.names) for b in run(iter([batch]))]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 60e6, (name, peak)
        assert len(rows) > 1
    assert sum(n for n, _ in rows) == len(text) and rows[0][1] == ["c0", "c1", "toxicity"]


def test_toxicity_of_a_column_that_is_no_text(spark):
    df = spark.createDataFrame([(1, 12), (2, None)], "doc_id bigint, number int")
    kept = toxicity.drop_toxic(df, (np.zeros(0, np.int64), np.zeros(0), -35.0), text_col="number")
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == [(1, 12), (2, None)]
