"""Chunkers against folds in plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.operators import chunking


def pack(parts, size, glue, long=None, keep=False):
    done, now = [], ""
    for p in parts:
        joined = now + glue + p if now else p
        if len(joined) <= size:
            now = joined
            continue
        if now:
            done.append(now)
        now = ""
        if len(p) > size:
            own = [p] if long is None else long(p)
            if keep and own:
                now = own.pop()
            done += own
        else:
            now = p
    return done + [now] if now else done


def recursive(text, size, seps=("\n\n", "\n", ". ", " ")):
    if not text:
        return []
    if len(text) <= size:
        return [text]
    if not seps:
        return [text[i : i + size] for i in range(0, len(text), size)]
    return pack(text.split(seps[0]), size, seps[0], lambda p: recursive(p, size, seps[1:]))


def overlapped(pieces, size, n):
    return [p if i == 0 else (pieces[i - 1][-n:] + p)[:size] for i, p in enumerate(pieces)]


def placed(pieces, text, overlap):
    out, cursor = [], 0
    for p in pieces:
        at = text.find(p, max(0, cursor - overlap))
        at = cursor if at < 0 else at
        cursor = at + len(p)
        out.append((p, at, cursor))
    return out


def by_sentences(text, size):
    return pack(re.split(r"(?<=[.!?])\s+", text), size, " ", lambda s: pack(s.split(), size, " "), keep=True)


def semantic(text, size, overlap):
    heads = [m.start() for m in re.finditer(r"(?m)^#{1,6}\s+.+$", text)]
    paragraphs = lambda s: [p for p in s.split("\n\n") if p.strip()]
    if heads:
        cuts = sorted({0, *heads, len(text)})
        parts = [text[a:b] for a, b in zip(cuts, cuts[1:]) if text[a:b].strip()]
        parts = [q for p in parts for q in (paragraphs(p) if len(p) > size else [p])]
    else:
        parts = paragraphs(text)
    merged = [p.strip() for p in pack(parts, size, "\n\n", lambda s: by_sentences(s, size))]
    return [c for c in placed(merged, text, overlap) if c[0]]


def code(text, size):
    cuts = sorted({0, len(text), *(m.start() for m in re.finditer(r"(?m)^(?:class\s+\w+|def\s+\w+|async\s+def\s+\w+)", text))})
    segments = [(text[a:b], a) for a, b in zip(cuts, cuts[1:]) if text[a:b].strip()]
    out, now, at = [], "", 0

    def flush():
        if not now:
            return
        if len(now) <= size:
            out.append((now, at, at + len(now)))
            return
        cur, pos = "", at
        for line in now.split("\n"):
            if cur and len(cur) + len(line) + 1 > size:
                out.append((cur, pos, pos + len(cur)))
                pos += len(cur)
                cur = ""
            cur += line + "\n"
        if cur.strip():
            out.append((cur, pos, pos + len(cur)))

    for s, start in segments:
        if now and len(now) + len(s) <= size:
            now += s
            continue
        flush()
        now, at = s, start
    flush()
    return out


def texts(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.choice([1, 3, 5, 9, 60])))
    glue = [" ", " ", " ", ". ", "! ", "\n", "\n\n", "\n\n# ", "\n## ", " (x) "]
    return ["".join(word() + rng.choice(glue) for _ in range(rng.randrange(1, 120))) for _ in range(120)] + ["", " ", "x", "# a", "#\nb", "a\n\n\n\nb", "y" * 300]


def run(spark, values, column):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", column(F.col("t")).alias("c")).collect()
    return {r.i: r.c for r in rows}


@pytest.mark.parametrize("size", [20, 57, 200])
def test_recursive(spark, size):
    values = texts()
    got = run(spark, values, lambda t: chunking.chunk_recursive(t, size, 10))
    for i, t in enumerate(values):
        assert [tuple(c) for c in got[i]] == placed(overlapped(recursive(t, size), size, 10), t, 10)


@pytest.mark.parametrize("size", [30, 120])
def test_semantic_and_sentences(spark, size):
    values = texts(5)
    got = run(spark, values, lambda t: chunking.chunk_semantic(t, size, 10))
    packed = run(spark, values, lambda t: chunking.sentence_pieces(t, size))
    for i, t in enumerate(values):
        assert [tuple(c) for c in got[i]] == semantic(t, size, 10)
        assert [p for p in packed[i]] == [p for p in by_sentences(t, size)]


def test_code(spark):
    rng = random.Random(9)
    lines = ["import x", "", "class A:", "    def f(self):", "        pass", "def g():", "    return 1", "async def h():", "y = 2  # long " + "z" * 50]
    values = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 40))) for _ in range(80)] + [""]
    got = run(spark, values, lambda t: chunking.chunk_code(t, F.lit("a.py"), 90))
    for i, t in enumerate(values):
        assert [tuple(c) for c in got[i]] == code(t, 90)
    js = "import a\nfunction f() {}\nconst g = (x) => x\nclass B {}\nexport const h = (y) => y\n"
    (out,) = run(spark, [js], lambda t: chunking.code_segments(t, chunking.code_language(F.lit("m.ts")))).values()
    assert [s.content.split("\n")[0] for s in out] == js.strip().split("\n")


def test_table(spark):
    csv = "id,value\n" + "\n".join(f"{i},{i * 10}" for i in range(100))
    df = spark.createDataFrame([(1, csv), (2, "a,b,c"), (3, "  \n"), (4, None)], "k int, content string")
    rows = sorted(chunking.chunk_table(df, size=60).collect(), key=lambda r: (r.k, r.pos))
    one = [r for r in rows if r.k == 1]
    assert all(r.content.startswith("id,value\n") for r in one)
    per = int((60 - len("id,value") - 1) / (sum(len(x) + 1 for x in csv.split("\n")[1:11]) / 10))  # from the first ten rows, whatever follows
    assert [r.row_count for r in one] == [per] * (100 // per) + ([100 % per] if 100 % per else [])
    assert "\n".join(r.content.split("\n", 1)[1] for r in one) == csv.split("\n", 1)[1]
    assert [(r.row_start, r.row_end) for r in one][:2] == [(0, one[0].row_count), (one[0].row_count, 2 * one[0].row_count)]
    assert all(csv[r.start_index : r.end_index].rstrip("\n") == r.content.split("\n", 1)[1] for r in one)
    assert [(r.k, r.content, r.row_count) for r in rows if r.k != 1] == [(2, "a,b,c", 0)]


def test_hierarchy(spark):
    text = "intro\n\n# One\nfirst para\n\nsecond para\n\nUnder\n=====\nbody\n## Two\n---\n" + "Long sentence here. " * 40
    df = spark.createDataFrame([("d", text), ("plain", "a\n\nb")], "doc_key string, content string")
    rows = chunking.chunk_hierarchical(df, size=100).collect()
    parents = {r.chunk_id: r for r in rows if r.chunk_type == "parent"}
    children = [r for r in rows if r.chunk_type == "child"]
    assert [r.section_title for r in sorted(parents.values(), key=lambda r: r.section) if r.doc_key == "d"] == ["", "One", "Under", "Two"]
    assert all(c.parent_chunk_id in parents for c in children)
    assert all(len(c.content) <= 100 for c in children)
    assert {c.content for c in children if c.section_title == "One"} == {"first para", "second para"}
    assert [p.section_title for p in parents.values() if p.doc_key == "plain"] == [""]


def test_registry(spark):
    df = spark.createDataFrame([("a b", "x.md", "md"), ("c", "x.py", "py"), ("h\n1", "x.csv", "csv"), ("d", "x.zzz", "zzz"), (None, "n", "txt"), ("", "e", "txt")], "content string, source string, doc_type string")
    got = {r.source: r.strategy for r in chunking.chunk_documents(df).collect()}
    assert got == {"x.md": "semantic", "x.py": "code_aware", "x.csv": "table", "x.zzz": "recursive"}
    chunking.register_chunker("whole", lambda t, s: F.array(F.struct(t.alias("content"), F.lit(0).alias("start_index"), F.length(t).alias("end_index"))))
    assert {r.strategy for r in chunking.chunk_documents(df.where("content <> ''"), "whole").collect()} == {"whole"}
    assert {r.strategy for r in chunking.chunk_documents(df, "adaptive").collect()} == {"recursive"}


def test_descriptions(spark):
    values = ["# Head\nx 2024-01-02 and 2024/03/04, 2024-01-02, 05-06-2024", "Over\n====\n", "z" * 130, "", "  \n second"]
    assert list(run(spark, values, chunking.title).values()) == ["Head", "Over", "z" * 100 + "...", None, "second"]
    assert list(run(spark, values, chunking.dates).values())[0] == ["2024-01-02", "2024/03/04", "05-06-2024"]
    assert list(run(spark, values, chunking.word_count).values())[1:4] == [1, 1, 0]
