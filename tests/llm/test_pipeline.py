"""The pipeline against brute force, and its registration."""

import random
from collections import defaultdict
from itertools import combinations

import corpus_pipeline
from millrace.llm import catalog
from test_corpus_operators import best_fit, gram_set, near, prose


def corpus():
    """Documents of which it is known what each stage has to do."""
    rng = random.Random(11)
    texts, toxic = [], []
    for i in range(500):
        t = prose(rng, rng.randrange(40, 200))
        if i % 5 == 0:
            w = t.split(" ")
            for bad in ("rotten", "vermin", "scum"):
                w.insert(rng.randrange(len(w)), bad)
            t = " ".join(w)
        texts.append(t)
        toxic.append(i % 5 == 0)
    clean = [t for t, x in zip(texts, toxic) if not x]
    for i in range(40):
        texts.append(clean[i] if i % 2 else near(rng, clean[i], 0.02))
        toxic.append(False)
    for i in range(20):
        secret = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        texts.append(prose(rng, 60) + " " + secret + " " + prose(rng, 10))
        toxic.append(False)
    texts += ["", None, "", prose(rng, 9000)]
    return texts, toxic + [False] * 4


def test_pipeline_against_brute_force(spark, tmp_path):
    texts, toxic = corpus()
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(x)) for i, x in enumerate(toxic) if texts[i]]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    kept = {i: t for i, t in enumerate(texts) if not toxic[i]}
    seen = set()
    for i, t in list(kept.items()):
        if t is not None and t in seen:
            del kept[i]
        seen.add(t)
    sets = {i: gram_set(t, 2) for i, t in kept.items()}
    label = {i: i for i in kept}
    for i, j in combinations(sorted(kept), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.65:
            a, b = label[i], label[j]
            label = {k: min(a, b) if x in (a, b) else x for k, x in label.items()}
    kept = {i: t for i, t in kept.items() if label[i] == i}
    words = {i: len((t or "").split()) for i, t in kept.items()}

    docs, counts = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{n}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{n}"))
        counts.append(docs.count())
    assert counts[0] == sum(not x for x in toxic) and counts[1] < counts[0] and counts[2] == counts[3] == len(kept)
    masked = {r.doc_id: r for r in docs.collect()}
    assert sum("[SECRET]" in (r.text or "") for r in masked.values()) == 20
    assert all(r.text is None or r.n_chars == len(r.text) for r in masked.values())

    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    per, bins = defaultdict(int), defaultdict(int)
    for r in found:
        per[r.doc_id] += r.piece_length
        if r.bin_id is not None:
            bins[r.bin_id] += r.piece_length
    assert per == words
    assert max(bins.values()) <= 2048 and len(bins) == len(best_fit([r.piece_length for r in found if r.piece_length], 2048)[0])


def test_names():
    assert sorted(int(k[2:].split("_")[0]) for k in catalog.QUERIES) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "secret scans", "best-fit packing"]
