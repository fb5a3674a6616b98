"""From landed text to addressed passages, and from documents to chunks.

Lines come as (file, line_no, text).  Every parser orders by line_no and works inside one file, so files parse in parallel.
"""

from __future__ import annotations

import html as _html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shabdagrid.operators.windows import carry_forward, last_known, run_id, running_count, shifted_groups

AV_ID = r"\(AV[ŚśSs]?\x{301}?_(\d+),(\d+)\.(\d+)([a-z]*)\)\s*(.*)$"
PB_ID = r"^\(PB\s+(\d+)\.(\d+)\.(\d+)\)\s*(.*)$"
SB_ID = r"^(\d+)\.(\d+)\.(\d+)\.(?:\[(\d+)\]|(\d+))\s*$"
RV_ID = r"\|\|\s*(\d+)\\?\.(\d+)\\?\.(\d+)"
WORD_LINK = r"<a[^>]*>([^<]*)</a>"
SEPARATORS = ["\n\n", "\n", "# ", "## "]


def _joined(c: str, order: str):
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, c))), lambda x: x[c]), " ")


BLOCK_LINES = 50_000


def line_block(size: int = BLOCK_LINES):
    """Blocks of consecutive lines, for scans of long files."""
    return F.floor(F.col("line_no") / size)


def half_lines(lines: DataFrame) -> DataFrame:
    """(file, book, hymn, verse, text): consecutive half-lines of one id joined; end markers and bars out; longer than two characters."""
    t = F.trim("text")
    g = lambda n: F.regexp_extract(t, AV_ID, n)
    x = lines.where(t.rlike(AV_ID)).select("file", "line_no", *[g(i).cast("int").alias(n) for i, n in ((1, "book"), (2, "hymn"), (3, "verse"))], F.trim(g(5)).alias("half"))
    r = run_id(x, ["file"], ["line_no"], F.concat_ws(".", "book", "hymn", "verse"), block=line_block())
    v = r.groupBy("file", "run", "book", "hymn", "verse").agg(_joined("half", "line_no").alias("t"))
    body = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("t", r"\|+\s*\d+\s*\|*\s*$", ""), r"\|", " "), r"\s+", " "))
    return v.select("file", "run", "book", "hymn", "verse", body.alias("text")).where(F.length("text") > 2)


def closed_verses(lines: DataFrame) -> DataFrame:
    """(file, mandala, hymn, verse, text): lines buffered until one carries the id, cut at the last bars, accents marks out."""
    s = F.trim("text")
    x = lines.where((s != "") & ~s.rlike(r"^[%\\#]")).select("file", "line_no", s.alias("s"))
    grp = shifted_groups(x, ["file"], ["line_no"], F.col("s").rlike(RV_ID), block=line_block())
    v = grp.groupBy("file", "grp").agg(_joined("s", "line_no").alias("t"), F.max_by("s", "line_no").alias("last")).where(F.col("last").rlike(RV_ID))
    cut = F.regexp_replace(F.regexp_replace(F.regexp_extract("t", r"(?s)^(.*)\|\|", 1), r"[\\`']", ""), r"\s+", " ")
    ids = [F.regexp_extract("last", RV_ID, i).cast("int").alias(n) for i, n in ((1, "mandala"), (2, "hymn"), (3, "verse"))]
    return v.select("file", *ids, F.trim(cut).alias("text"))


def headed_paragraphs(lines: DataFrame, book: int | None = None, skip: str | None = None) -> DataFrame:
    """(file, book, adhyaya, brahmana, para, text): an id alone on a line opens a paragraph; bodies over ten characters; one book if asked."""
    t = F.trim("text")
    x = lines.select("file", "line_no", t.alias("s"), F.when(t.rlike(SB_ID), t).alias("_id"))
    x = last_known(x, ["file"], ["line_no"], "_id", "id", line_block())
    x = running_count(x, ["file"], ["line_no"], F.col("_id").isNotNull(), "run", block=line_block()).where("_id is null and id is not null and s != ''")
    x = x if skip is None else x.where(~F.col("s").rlike(skip))
    v = x.groupBy("file", "run", "id").agg(_joined("s", "line_no").alias("t"))
    n = lambda i: F.regexp_extract("id", SB_ID, i)
    v = v.select("file", n(1).cast("int").alias("book"), n(2).cast("int").alias("adhyaya"), n(3).cast("int").alias("brahmana"),
                 F.coalesce(F.nullif(n(4), F.lit("")), n(5)).cast("int").alias("para"), F.regexp_replace("t", r"\s+", " ").alias("text"))
    v = v.where(F.length("text") > 10)
    return v if book is None else v.where(F.col("book") == book)


def tagged_paragraphs(lines: DataFrame) -> DataFrame:
    """(file, line_no, part, book, chapter, para, text): lines with several leading tags give one row for each."""
    p = lines.select("file", "line_no", F.posexplode(F.split("text", r"(?=\(PB\s+\d+\.\d+\.\d+\))")).alias("part", "s"))
    g = lambda i: F.regexp_extract(F.trim("s"), PB_ID, i)
    return p.where(F.trim("s").rlike(PB_ID) & (F.trim(g(4)) != "")).select(
        "file", "line_no", "part", g(1).cast("int").alias("book"), g(2).cast("int").alias("chapter"), g(3).cast("int").alias("para"), F.trim(g(4)).alias("text")
    )


def hymn_index(lines: DataFrame) -> DataFrame:
    """(mandala, line_no, hymn_id, rishi, devata, meter, verses, valid) of index lines(mandala, line_no, text).

    Lines that are not five dot-separated fields with two numbers have valid = false; header and blank lines are left out.
    """
    t = F.trim("text")
    p = F.split(t, r"\.")
    x = lines.where((t != "") & ~t.startswith("hymn.verses")).select("mandala", "line_no", p.alias("p"))
    hy, vs = F.get("p", F.lit(0)).try_cast("int"), F.get("p", F.lit(1)).try_cast("int")
    ok = F.coalesce((F.size("p") == 5) & hy.isNotNull() & vs.isNotNull(), F.lit(False))
    field = lambda i: F.when(ok, F.trim(F.get("p", F.lit(i))))
    return x.select("mandala", "line_no", F.when(ok, F.format_string("%d.%03d", "mandala", hy)).alias("hymn_id"), field(2).alias("rishi"),
                    field(3).alias("devata"), field(4).alias("meter"), F.when(ok, vs).alias("verses"), ok.alias("valid"))


def latest_hymns(parsed: DataFrame) -> DataFrame:
    """One row per hymn id, the last line of it."""
    v = parsed.where("valid")
    cols = ["rishi", "devata", "meter", "verses"]
    return v.groupBy("hymn_id").agg(F.max_by(F.struct(*cols), F.struct("mandala", "line_no")).alias("b")).select("hymn_id", "b.*")


def html_text(pages: DataFrame, html: str, out: str = "text", skip: str | None = None) -> DataFrame:
    """pages with readable text: entities decoded, word links unwrapped, tags out, footer cut, lines that match `skip` out."""

    @F.pandas_udf("string")
    def unescape(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else _html.unescape(x).replace("\xa0", " ") for x in s], dtype=object)

    t = F.regexp_replace(F.regexp_replace(unescape(F.col(html)), WORD_LINK, "$1 "), "<[^>]+>", " ")
    body = F.split(F.regexp_replace(t, r"[ \t]+", " "), "This text is part of", 2)[0]
    if skip:
        body = F.regexp_replace(body, f"(?m)^.*(?:{skip}).*$", "")
    return pages.withColumn(out, F.regexp_replace(body, "^ +| +$", ""))


MARKERS = r"(Book|Chapter|Paragraph|Verse|Sentence):\s*(\d+|[a-z](?![a-z]))(?:=?([a-z])(?![a-z]))?"


def marked_sentences(pages: DataFrame, file: str, order: str, text: str, corpus: list[str] | None = None, needs: str = "verse") -> DataFrame:
    """(file, pos, book, chapter, paragraph, verse, sentence, letter, text) from pages with structural labels.

    A sentence ends at the next label of any kind.  Book and chapter carry over to later files of the same `corpus`; a new higher level clears those below.
    Files are the blocks of the scan, so a corpus of any size is read in parallel.
    """
    group = corpus or []
    cells = F.split(F.col(text), rf"(?={MARKERS})")
    m = pages.select(*group, file, order, F.posexplode(cells).alias("pos", "cell"))
    g = lambda i: F.regexp_extract("cell", "(?s)^" + MARKERS + "(.*)$", i)
    m = m.where(g(1) != "").select(*group, file, order, "pos", F.lower(g(1)).alias("kind"), g(2).try_cast("int").alias("n"), F.when(g(2).rlike("[a-z]"), g(2)).otherwise(g(3)).alias("letter"), F.trim(F.regexp_replace(g(4), r"\s+", " ")).alias("body"))
    levels = ["book", "chapter", "paragraph", "verse"]
    for lv in levels:
        m = m.withColumn(lv, F.when(F.col("kind") == lv, F.col("n")))
    filled = carry_forward(m, group, [order, "pos"], levels, block=F.col(order))
    return filled.where((F.col("kind") == "sentence") & F.col(needs).isNotNull() & (F.col("body") != "")).select(*group, file, order, "pos", *levels, F.col("n").alias("sentence"), "letter", F.col("body").alias("text"))


def marked_verses(sentences: DataFrame, file: str, order: str, corpus: list[str] | None = None) -> DataFrame:
    """Sentences of one verse joined in their order; longer than five characters."""
    levels = ["book", "chapter", "paragraph", "verse"]
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "pos", "text"))), lambda x: x["text"]), " ")
    return sentences.groupBy(*(corpus or []), *levels).agg(F.min(file).alias(file), text.alias("text")).where(F.length("text") > 5)


def book_headers(docs: DataFrame, text: str) -> DataFrame:
    """docs with book, canto and the number of the first numbered section, '' where absent."""
    return (
        docs.withColumn("book", F.regexp_extract(text, r"#\s+Book\s+([IVXLC]+)\.", 1))
        .withColumn("canto", F.regexp_extract(text, r"##\s+Canto\s+([IVXLC]+)\.", 1))
        .withColumn("section", F.regexp_extract(text, r"(?m)^\s*(\d+)\.\s+", 1))
    )


def _merge(splits: list[str], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    window: list[str] = []
    total = 0
    for s in splits:
        if window and total + len(s) > size:
            out.append("".join(window))
            while window and (total > overlap or total + len(s) > size):
                total -= len(window.pop(0))
        window.append(s)
        total += len(s)
    if window:
        out.append("".join(window))
    return out


def recursive_chunks(text: str, size: int = 512, overlap: int = 64, separators: list[str] | None = None) -> list[str]:
    """Chunks by the first separator that occurs, larger parts by the next ones; a part without separators stays whole."""
    seps = SEPARATORS if separators is None else separators
    sep = next((s for s in seps if s in text), seps[-1] if seps else "")
    rest = seps[seps.index(sep) + 1 :] if sep in seps else []
    raw = text.split(sep) if sep and sep in text else [text]
    parts = [p for p in [raw[0], *[sep + p for p in raw[1:]]] if p]
    out: list[str] = []
    good: list[str] = []
    for p in parts:
        if len(p) < size:
            good.append(p)
            continue
        out += _merge(good, size, overlap)
        good = []
        out += recursive_chunks(p, size, overlap, rest) if rest else [p]
    out += _merge(good, size, overlap)
    return [c.strip() for c in out if c.strip()]


def chunk_documents(docs: DataFrame, id_col: str, text: str, size: int = 512, overlap: int = 64) -> DataFrame:
    """(id, pos, page_content, original_content_length): chunks of every document in order, by Arrow batches."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, n, c, len(t)) for i, t in zip(b[id_col], b[text]) if t is not None for n, c in enumerate(recursive_chunks(t, size, overlap))]
            yield pd.DataFrame(rows, columns=[id_col, "pos", "page_content", "original_content_length"])

    return docs.select(id_col, text).mapInPandas(run, f"`{id_col}` {kind}, pos int, page_content string, original_content_length int")


def emit_sections(verses: DataFrame, group: list[str], section: list[str], order: list[str], header, line, block=None) -> DataFrame:
    """(group, block, text): a file's verses as lines, a header line before each change of section, one row for each block of its lines.

    Where a section starts is told by the numbers of its runs, so that blocks are scanned in parallel and none repeats a header."""
    b = F.lit(0) if block is None else block
    r = run_id(verses, group, order, F.concat_ws("\u0001", *section), "_run", block)
    at = F.struct(*order)
    heads = r.groupBy(*group, "_run").agg(F.min_by(F.struct(*order, b.cast("long").alias("block"), header.alias("_h")), at).alias("f"))
    heads = heads.select(*group, "f.block", *[F.col(f"f.{o}").alias(o) for o in order], F.lit(0).alias("_p"), F.concat(F.lit("\n"), F.col("f._h"), F.lit("\n\n")).alias("_l"))
    lines = r.select(*group, b.cast("long").alias("block"), *order, F.lit(1).alias("_p"), F.concat(line, F.lit("\n")).alias("_l"))
    cells = F.collect_list(F.struct(*order, "_p", "_l"))
    g = lines.unionByName(heads).groupBy(*group, "block").agg(F.array_sort(cells).alias("c"))
    return g.select(*group, "block", F.array_join(F.transform("c", lambda x: x["_l"]), "").alias("text"))
