"""Chunkers: a text column becomes an array of pieces, without leaving the JVM.

Sizes and offsets count characters.  Greedy packing is a fold whose state is what is finished and
what is open.  Chunk ids are derived from what a chunk is, so that runs are reproducible.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import strip

SEPARATORS = ("\n\n", "\n", ". ", " ")
TYPE_STRATEGY = dict(
    [(t, "semantic") for t in "md markdown rst html".split()] + [(t, "recursive") for t in "txt text pdf json yaml yml".split()]
    + [(t, "code_aware") for t in "py js ts".split()] + [("csv", "table")]
)
_SENTENCE = r"(?<=[.!?])\s+"
_EMPTY = "array<string>"


def _none() -> Column:
    return F.array().cast(_EMPTY)


def pack(parts: Column, size: int, glue: str, oversize: Callable[[Column], Column] | None = None, keep_rest: bool = False) -> Column:
    """Join neighbours with ``glue`` while they fit in ``size``.

    A part that is too long by itself closes the open piece; ``oversize`` says which pieces it becomes
    (itself if None), and with ``keep_rest`` the last of these stays open.
    """

    def step(acc: Column, part: Column) -> Column:
        opened = F.when(acc["open"] == "", part).otherwise(F.concat(acc["open"], F.lit(glue), part))
        closed = F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        own = F.array(part) if oversize is None else oversize(part)
        if keep_rest:
            long = F.struct(F.concat(closed, F.when(F.size(own) > 1, F.slice(own, F.lit(1), F.size(own) - 1)).otherwise(_none())).alias("done"), F.coalesce(F.try_element_at(own, F.lit(-1)), F.lit("")).alias("open"))
        else:
            long = F.struct(F.concat(closed, own).alias("done"), F.lit("").alias("open"))
        return (
            F.when(F.length(opened) <= size, F.struct(acc["done"].alias("done"), opened.alias("open")))
            .when(F.length(part) > size, long)
            .otherwise(F.struct(closed.alias("done"), part.alias("open")))
        )

    start = F.struct(_none().alias("done"), F.lit("").alias("open"))
    return F.aggregate(parts, start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def hard_slices(text: Column, size: int) -> Column:
    last = F.floor((F.greatest(F.length(text), F.lit(1)) - 1) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def recursive_pieces(text: Column, size: int = 512, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """Pack parts between the first separator; what is too long goes on with the next one, in the end to slices."""
    pieces = F.when(F.length(text) > 0, F.array(text)).otherwise(_none())

    def at(separator: str) -> Callable[[Column], Column]:
        return lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(pack(F.split(p, re.escape(separator).replace("\\ ", " "), -1), size, separator))

    for separator in separators:
        pieces = F.flatten(F.transform(pieces, at(separator)))
    return F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(hard_slices(p, size))))


def with_overlap(pieces: Column, size: int, overlap: int) -> Column:
    """Every piece but the first begins with the last characters of the one before; what then exceeds ``size`` is cut off."""
    if overlap <= 0:
        return pieces

    def step(acc: Column, p: Column) -> Column:
        joined = F.when(F.size(acc["done"]) == 0, p).otherwise(F.substring(F.concat(F.right(acc["before"], F.lit(overlap)), p), F.lit(1), F.lit(size)))
        return F.struct(F.concat(acc["done"], F.array(joined)).alias("done"), p.alias("before"))

    return F.aggregate(pieces, F.struct(_none().alias("done"), F.lit("").alias("before")), step, lambda acc: acc["done"])


_CHUNK = "array<struct<content:string,start_index:int,end_index:int>>"


def with_offsets(pieces: Column, text: Column, overlap: int) -> Column:
    """Where each piece is, searched from where the last one ended less ``overlap``; if it isn't there, it counts from that end."""

    def step(acc: Column, p: Column) -> Column:
        at = F.locate(p, text, F.greatest(F.lit(0), acc["cursor"] - overlap) + 1) if isinstance(p, str) else F.call_function("locate", p, text, F.greatest(F.lit(0), acc["cursor"] - overlap) + 1)
        start = F.when(at > 0, at - 1).otherwise(acc["cursor"]).cast("int")
        end = (start + F.length(p)).cast("int")
        chunk = F.struct(p.alias("content"), start.alias("start_index"), end.alias("end_index"))
        return F.struct(F.concat(acc["done"], F.array(chunk)).alias("done"), end.alias("cursor"))

    return F.aggregate(pieces, F.struct(F.array().cast(_CHUNK).alias("done"), F.lit(0).alias("cursor")), step, lambda acc: acc["done"])


def chunk_recursive(text: Column, size: int = 512, overlap: int = 50) -> Column:
    return with_offsets(with_overlap(recursive_pieces(text, size), size, overlap), text, overlap)


def _word_pieces(text: Column, size: int) -> Column:
    return pack(F.filter(F.split(text, r"\s+"), lambda w: w != ""), size, " ")


def sentence_pieces(text: Column, size: int) -> Column:
    """Pack sentences; one that is too long is packed by words and its rest stays open."""
    return pack(F.split(text, _SENTENCE), size, " ", lambda s: _word_pieces(s, size), keep_rest=True)


def semantic_sections(text: Column, size: int) -> Column:
    """Cut before headings, or at blank lines where there is no heading or a section is too long."""
    filled = lambda parts: F.filter(parts, lambda s: strip(s) != "")
    paragraphs = lambda s: filled(F.split(s, "\n\n", -1))
    heading = r"(?md)^#{1,6}\s+.+$"
    sections = F.split(text, r"(?md)(?=^#{1,6}\s+.+$)", -1)
    # the last section is kept even if blank, as all begin with a heading but the first
    cut = F.flatten(F.transform(filled(sections), lambda s: F.when(F.length(s) > size, paragraphs(s)).otherwise(F.array(s))))
    return F.when(text.rlike(heading), cut).otherwise(paragraphs(text))


def chunk_semantic(text: Column, size: int = 512, overlap: int = 50) -> Column:
    merged = pack(semantic_sections(text, size), size, "\n\n", lambda s: sentence_pieces(s, size))
    return F.filter(with_offsets(F.transform(merged, strip), text, overlap), lambda c: c["content"] != "")


_PYTHON = r"class\s+\w+|def\s+\w+|async\s+def\s+\w+"
_SCRIPT = (
    r"class\s+\w+|function\s+\w+|export\s+function\s+\w+|export\s+default\s+function\s+\w+"
    r"|const\s+\w+\s*=\s*\(.*?\)\s*=>|const\s+\w+\s*=\s*async\s*\(.*?\)\s*=>|export\s+const\s+\w+\s*=\s*\(.*?\)\s*=>"
)
LANGUAGES = {"py": _PYTHON, "python": _PYTHON} | dict.fromkeys(("js", "javascript", "ts", "typescript"), _SCRIPT)


def code_language(source: Column, default: str = "py") -> Column:
    ext = F.lower(F.element_at(F.split(source, r"\."), -1))
    return F.when(source.contains(".") & ext.isin(*LANGUAGES), ext).otherwise(F.lit(default))


def code_segments(text: Column, language: Column) -> Column:
    """Cut before every definition at the start of a line; blank segments are left out."""
    cut = {p: F.split(text, rf"(?md)(?=^(?:{p}))", -1) for p in (_PYTHON, _SCRIPT)}
    parts = F.when(language.isin("py", "python"), cut[_PYTHON]).otherwise(cut[_SCRIPT])
    return F.filter(_placed(parts), lambda s: strip(s["content"]) != "")


def _placed(parts: Column) -> Column:
    """Neighbouring parts of a text with where they start, ``array<struct<content, start>>``."""
    step = lambda acc, p: F.struct(F.concat(acc["done"], F.array(F.struct(p.alias("content"), acc["at"].alias("start")))).alias("done"), (acc["at"] + F.length(p)).alias("at"))
    return F.aggregate(parts, F.struct(F.array().cast("array<struct<content:string,start:int>>").alias("done"), F.lit(0).alias("at")), step, lambda acc: acc["done"])


def _line_pieces(text: Column, start: Column, size: int) -> Column:
    def step(acc: Column, line: Column) -> Column:
        longer = F.concat(acc["open"], line, F.lit("\n"))
        full = (F.length(longer) > size) & (acc["open"] != "")
        chunk = F.struct(acc["open"].alias("content"), acc["at"].alias("start_index"), (acc["at"] + F.length(acc["open"])).alias("end_index"))
        return F.when(full, F.struct(F.concat(acc["done"], F.array(chunk)).alias("done"), F.concat(line, F.lit("\n")).alias("open"), (acc["at"] + F.length(acc["open"])).alias("at"))).otherwise(
            F.struct(acc["done"].alias("done"), longer.alias("open"), acc["at"].alias("at"))
        )

    def finish(acc: Column) -> Column:
        chunk = F.struct(acc["open"].alias("content"), acc["at"].alias("start_index"), (acc["at"] + F.length(acc["open"])).alias("end_index"))
        return F.when(strip(acc["open"]) != "", F.concat(acc["done"], F.array(chunk))).otherwise(acc["done"])

    return F.aggregate(F.split(text, "\n", -1), F.struct(F.array().cast(_CHUNK).alias("done"), F.lit("").alias("open"), start.alias("at")), step, finish)


def chunk_code(text: Column, source: Column, size: int = 512, default: str = "py") -> Column:
    """Neighbouring segments together while they fit; what is too long is cut at line ends."""

    def flushed(acc: Column) -> Column:
        whole = F.array(F.struct(acc["open"].alias("content"), acc["at"].alias("start_index"), (acc["at"] + F.length(acc["open"])).alias("end_index")))
        own = F.when(F.length(acc["open"]) > size, _line_pieces(acc["open"], acc["at"], size)).otherwise(whole)
        return F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], own))

    def step(acc: Column, s: Column) -> Column:
        fits = F.length(acc["open"]) + F.length(s["content"]) <= size
        return (
            F.when(acc["open"] == "", F.struct(acc["done"].alias("done"), s["content"].alias("open"), s["start"].alias("at")))
            .when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], s["content"]).alias("open"), acc["at"].alias("at")))
            .otherwise(F.struct(flushed(acc).alias("done"), s["content"].alias("open"), s["start"].alias("at")))
        )

    start = F.struct(F.array().cast(_CHUNK).alias("done"), F.lit("").alias("open"), F.lit(0).alias("at"))
    return F.aggregate(code_segments(text, code_language(source, default)), start, step, flushed)


def table_rows_per_chunk(header: Column, rows: Column, size: int = 512, most: int = 20) -> Column:
    """How many rows fit beside the header, from the mean length of the first ten; at least 1, at most ``most``."""
    sample = F.slice(rows, 1, 10)
    mean = F.aggregate(sample, F.lit(0), lambda n, r: n + F.length(r) + 1) / F.size(sample)
    room = F.lit(size) - F.length(header) - 1
    return F.when(F.size(rows) == 0, F.lit(most)).when(room <= 0, F.lit(1)).otherwise(F.least(F.lit(most), F.greatest(F.lit(1), F.floor(room / F.when(F.size(rows) > 0, mean)).cast("int"))))


def chunk_table(df: DataFrame, text_col: str = "content", size: int = 512, most: int = 20, delimiter: str = ",") -> DataFrame:
    """Slices of rows under the header; ``df`` with ``pos, content, start_index, end_index, row_start, row_end, row_count, column_count``.

    The text column is replaced.  A blank text has no chunk, and one with only a header has that, with 0 rows.
    """
    keep = [c for c in df.columns if c != text_col]
    lines = df.select(*keep, strip(F.col(text_col)).alias("_text")).where("_text <> ''").select("*", F.split("_text", "\n", -1).alias("_lines"))
    rows = lines.select(*keep, "_text", F.get("_lines", F.lit(0)).alias("_header"), F.slice("_lines", F.lit(2), F.size("_lines")).alias("_rows"))
    sized = rows.select("*", table_rows_per_chunk(F.col("_header"), F.col("_rows"), size, most).alias("_n"))
    each = sized.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.greatest(F.size("_rows"), F.lit(1)) - 1) / F.col("_n")).cast("int"))).alias("pos"))
    each = each.withColumn("row_start", F.col("pos") * F.col("_n")).withColumn("_mine", F.slice("_rows", F.col("row_start") + 1, F.col("_n")))
    empty = F.size("_rows") == 0
    start = F.length(F.call_function("substring_index", F.col("_text"), F.lit("\n"), F.col("row_start") + 1)) + 1
    body = F.array_join("_mine", "\n")
    none = F.lit(None).cast("int")
    unless = lambda c: F.when(empty, none).otherwise(c)
    return each.select(
        *keep, "pos", F.when(empty, F.col("_header")).otherwise(F.concat("_header", F.lit("\n"), body)).alias("content"),
        F.when(empty, 0).otherwise(start).alias("start_index"), F.when(empty, F.length("_header")).otherwise(start + F.length(body) + 1).alias("end_index"),
        unless(F.col("row_start")).alias("row_start"), unless(F.col("row_start") + F.size("_mine")).alias("row_end"), F.size("_mine").alias("row_count"),
        unless(F.size(F.split("_header", re.escape(delimiter), -1))).alias("column_count"),
    )


_MARK = "\u0001"


def sections(text: Column) -> Column:
    """Sections under headings, ``array<struct<title, body, start>>``: lines that begin with # or are underlined with = or -.

    A line that is a heading in two ways is one heading; offsets are those of the heading.
    """
    marked = F.regexp_replace(text, r"(?md)^(?=#{1,6}\s+.+$|.+\n(?:={3,}|-{3,})$)", _MARK)
    parts = F.split(marked, _MARK, -1)
    atx, under = r"^#{1,6}\s+[^\n]+", r"^[^\n]+\n(?:={3,}|-{3,})(?=\n|$)"

    def one(s: Column, i: Column) -> Column:
        p = s["content"]
        head = F.when(i == 0, F.lit("")).when(p.rlike(atx), F.regexp_extract(p, f"({atx})", 1)).otherwise(F.regexp_extract(p, f"({under})", 1))
        title = strip(F.get(F.split(F.regexp_replace(strip(head), r"^#{1,6}\s+", ""), "\n", -1), F.lit(0)))
        return F.struct(title.alias("title"), strip(F.substring(p, F.length(head) + 1, F.length(p))).alias("body"), s["start"].alias("start"))

    found = F.filter(F.transform(_placed(parts), one), lambda s: (s["title"] != "") | (s["body"] != ""))
    whole = F.array(F.struct(F.lit("").alias("title"), text.alias("body"), F.lit(0).alias("start")))
    return F.when(text.contains(_MARK) | (F.size(parts) == 1) | (F.size(found) == 0), whole).otherwise(found)


def _paragraphs(body: Column, size: int) -> Column:
    parts = F.filter(F.transform(F.split(body, r"\n\s*\n", -1), strip), lambda p: p != "")
    return F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(F.filter(pack(F.split(p, _SENTENCE, -1), size, " "), lambda s: strip(s) != ""))))


def chunk_hierarchical(df: DataFrame, text_col: str = "content", key_col: str = "doc_key", size: int = 512, include_parents: bool = True) -> DataFrame:
    """Parents (sections, up to twice the size) and children (their paragraphs).

    ``(doc_key, section, chunk_type, pos, section_title, content, chunk_id, parent_chunk_id)``
    """
    each = df.select(F.col(key_col).alias("doc_key"), F.posexplode(sections(F.col(text_col))).alias("section", "s"))
    parent = F.sha2(F.concat_ws("|", "doc_key", F.lit("section"), "section"), 256)
    base = each.select("doc_key", "section", F.col("s.title").alias("section_title"), F.col("s.body").alias("body"), parent.alias("parent_id"))
    titled = F.when(F.col("section_title") != "", F.concat("section_title", F.lit("\n\n"), "body")).otherwise(F.col("body"))
    children = base.select("doc_key", "section", "section_title", "parent_id", F.posexplode(_paragraphs(F.col("body"), size)).alias("pos", "content"))
    children = children.select(
        "doc_key", "section", F.lit("child").alias("chunk_type"), "pos", "section_title", "content",
        F.sha2(F.concat_ws("|", "parent_id", "pos", "content"), 256).alias("chunk_id"), F.col("parent_id").alias("parent_chunk_id"),
    )
    if not include_parents:
        return children
    parents = base.select(
        "doc_key", "section", F.lit("parent").alias("chunk_type"), F.lit(-1).alias("pos"), "section_title", F.left(titled, F.lit(2 * size)).alias("content"),
        F.col("parent_id").alias("chunk_id"), F.lit(None).cast("string").alias("parent_chunk_id"),
    )
    return parents.unionByName(children)


_registry: dict[str, Callable[[Column, Column], Column]] = {}


def register_chunker(name: str, build: Callable[[Column, Column], Column]) -> None:
    """Add or replace a strategy: ``build(text, source)`` gives ``array<struct<content, start_index, end_index>>``."""
    _registry[name] = build


def strategy_for(doc_type: Column, strategy: str = "auto") -> Column:
    """The strategy by document type; a named one holds for all, and an unknown one means recursive."""
    if strategy != "auto":
        return F.lit(strategy if strategy in {*TYPE_STRATEGY.values(), "hierarchical", *_registry} else "recursive")
    table = F.create_map(*[F.lit(x) for pair in TYPE_STRATEGY.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(doc_type)), F.lit("recursive"))


def chunk_documents(docs: DataFrame, strategy: str = "auto", size: int = 512, overlap: int = 50) -> DataFrame:
    """``docs (content, source, doc_type)`` to ``(source, strategy, pos, content, start_index, end_index, chunk_id)``, each by its strategy."""
    text, source = F.col("content"), F.col("source")
    under = F.flatten(F.transform(sections(text), lambda s: _paragraphs(s["body"], size)))
    ways = {
        "recursive": chunk_recursive(text, size, overlap), "semantic": chunk_semantic(text, size, overlap), "code_aware": chunk_code(text, source, size),
        "hierarchical": with_offsets(under, text, overlap), **{n: b(text, source) for n, b in _registry.items()},
    }
    rows = docs.select("content", "source", strategy_for(F.col("doc_type"), strategy).alias("strategy"))
    chunks = None
    for name, way in ways.items():
        chunks = F.when(F.col("strategy") == name, way) if chunks is None else chunks.when(F.col("strategy") == name, way)
    columns = ["source", "strategy", "pos", "content", "start_index", "end_index"]
    out = rows.where("strategy <> 'table'").select("source", "strategy", F.posexplode(chunks).alias("pos", "c")).select("source", "strategy", "pos", "c.*").select(columns)
    if "table" not in ways:
        out = out.unionByName(chunk_table(rows.where("strategy = 'table'"), "content", size).select(columns))
    return out.withColumn("chunk_id", F.sha2(F.concat_ws("|", "source", "strategy", "pos", "content"), 256))


# what chunks say of themselves

_ATX, _SETEXT = r"(?md)^#{1,6}\s+(.+)$", r"(?md)^(.+)\n={3,}$"


def title(text: Column) -> Column:
    """First heading, else the first line that isn't blank, cut to 100 characters; null if there is none."""
    line = F.get(F.filter(F.transform(F.split(text, "\n", -1), strip), lambda x: x != ""), F.lit(0))
    short = F.when(F.length(line) > 100, F.concat(F.left(line, F.lit(100)), F.lit("..."))).otherwise(line)
    found = lambda p: F.when(text.rlike(p), strip(F.regexp_extract(text, p, 1)))
    return F.coalesce(found(_ATX), found(_SETEXT), short)


def dates(text: Column) -> Column:
    """Distinct dates by pattern, then place; null if there is none."""
    found = F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(rf"\b({p})\b"), F.lit(1)) for p in (r"\d{4}-\d{2}-\d{2}", r"\d{4}/\d{2}/\d{2}", r"\d{2}-\d{2}-\d{4}")]))
    return F.when(F.size(found) > 0, found)


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def enrich(chunks: DataFrame, titles: bool = True, with_dates: bool = True) -> DataFrame:
    out = chunks.withColumn("word_count", word_count(F.col("content")))
    if titles:
        out = out.withColumn("title", title(F.col("content")))
    return out.withColumn("dates", dates(F.col("content"))) if with_dates else out
