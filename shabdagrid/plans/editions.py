"""The ingest of every edition: landed pages or lines -> addressed verses in Devanagari -> Markdown view, metadata, chunks, index tables.

An edition is described by data; the parsers, cleaners and sinks are those of the operators.  Pages are landed files: nothing is fetched.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shabdagrid.functions.cleaners import edition_to_devanagari
from shabdagrid.operators import lexical, parse, search, windows
from shabdagrid.plans.ingest import layer_of
from shabdagrid.sources.files import replace_partition

Parser = Callable[[DataFrame], DataFrame]


@dataclass
class Edition:
    """parse gives rows with the columns of `levels` and text; header levels are those that change the sections of the Markdown view."""

    name: str
    work: str
    levels: list[str]
    parse: Parser
    headers: list[str]
    devanagari: bool = True
    marks: dict = field(default_factory=dict)  # which cleaning steps its transcription needs
    gloss: tuple[str, str] | None = None  # (address, note to be set behind it)
    layer: int | None = None
    layer_name: str | None = None


def _sentences(levels: list[str], skip: str | None, by_verse: bool) -> Parser:
    """Pages(file, page, text) of an HTML edition with structural labels."""

    def run(pages: DataFrame) -> DataFrame:
        plain = parse.html_text(pages, "text", "plain", skip)
        s = parse.marked_sentences(plain, "file", "page", "plain", needs="verse" if by_verse else "paragraph")
        if by_verse:
            return parse.marked_verses(s, "file", "page").select(*levels, "text")
        # the second level counts the paragraphs of a chapter, whatever their printed numbers are
        s = windows.reset_counter(s.where(F.length("text") > 2), ["chapter"], ["page", "pos"], F.col("paragraph"), "adhyaya", F.col("page"))
        return s.select(*levels, "text")

    return run


# The editorial gloss behind one sentence, and lines of the editions that are no text.
GLOSS = "[वैधस = Vaidhasa, patronymic: son of Vidhasa — Harishchandra's father is Vidhasa; ऐक्ष्वाक = of the Ikṣvāku solar dynasty]"
SKIP = r"TITUS|Thesaurus|Copyright|Frankfurt|Part No|Next part|Previous part"
EDITIONS = {
    "AB": Edition("ab", "AB", ["chapter", "adhyaya", "sentence"], _sentences(["chapter", "adhyaya", "sentence"], SKIP, False), ["chapter", "adhyaya"], gloss=("7.13.1", GLOSS)),
    "VS": Edition("yv", "VS", ["paragraph", "verse"], _sentences(["paragraph", "verse"], SKIP, True), ["paragraph"], marks={"accents": True, "labels": True}),
    "TS": Edition("ts", "TS", ["book", "chapter", "paragraph", "verse"], _sentences(["book", "chapter", "paragraph", "verse"], SKIP, True), ["book", "chapter", "paragraph"], marks={"accents": True, "variants": True, "labels": True}),
    "SB": Edition("sb", "SB", ["book", "adhyaya", "brahmana", "para"], parse.headed_paragraphs, ["book", "adhyaya", "brahmana"]),
    "PB": Edition("pb", "PB", ["book", "chapter", "para"], parse.tagged_paragraphs, ["book", "chapter"]),
    "AVS": Edition("avs", "AVS", ["book", "hymn", "verse"], parse.half_lines, ["book", "hymn"]),
    "RV": Edition("rv", "RV", ["mandala", "hymn", "verse"], parse.closed_verses, ["mandala", "hymn"]),
}


def verses_of(edition: Edition, landed: DataFrame) -> DataFrame:
    """(levels, address, text): the verses of an edition in Devanagari; verses without any letter are left out."""
    v = edition.parse(landed)
    text = edition_to_devanagari(F.col("text"), **edition.marks) if edition.devanagari else F.col("text")
    address = F.concat_ws(".", *[F.col(x).cast("string") for x in edition.levels])
    out = v.select(*edition.levels, address.alias("address"), F.trim(text).alias("text"))
    # The transliteration is not deterministic to Catalyst, so this filter is not pushed below it.
    return out.where(F.length("text") > 2)


def marked_lines(edition: Edition, v: DataFrame) -> DataFrame:
    """verses with `line`: the text and its address between double dandas, an editorial gloss behind the address that has one."""
    line = F.concat("text", F.lit(f" ॥ {edition.work} "), "address", F.lit(" ॥"))
    if edition.gloss:
        line = F.when(F.col("address") == edition.gloss[0], F.concat(line, F.lit(" " + edition.gloss[1]))).otherwise(line)
    return v.withColumn("line", line)


def markdown(edition: Edition, v: DataFrame) -> DataFrame:
    """(line_no, text): the Markdown view as ordered lines, a header of each level that changes before a verse; '#' for the top level.

    Verses are numbered within their sections and sections by their keys, so no window spans the edition."""
    order = [F.col(x) for x in edition.levels]
    heads = []
    for i, h in enumerate(edition.headers):
        keys = edition.headers[: i + 1]
        first = v.groupBy(*keys).agg(F.min(F.struct(*edition.levels)).alias("_a"))
        name = F.concat(F.lit("#" * (i + 1) + f" {edition.work} "), F.concat_ws(".", *[F.col(k).cast("string") for k in keys]))
        heads.append(first.select(*[F.col(f"_a.{x}").alias(x) for x in edition.levels], F.lit(i).alias("_p"), name.alias("text")))
    out = marked_lines(edition, v).select(*order, F.lit(len(edition.headers)).alias("_p"), F.col("line").alias("text"))
    for h in heads:
        out = out.unionByName(h)
    return out.select(F.struct(*order, "_p").alias("line_no"), "text")


def metadata(edition: Edition, **known) -> dict:
    """The metadata record of an edition; keys that are not given are absent."""
    base = {"filename": edition.name, "veda": edition.work, "source_type": "primary", "preprocessing": "sanskrit" if edition.devanagari else None, "chronology_layer": edition.layer, "chronology_name": edition.layer_name}
    return {k: v for k, v in (base | known).items() if v is not None}


def chunks_of(edition: Edition, v: DataFrame) -> DataFrame:
    """(filename, section, pos, page_content, layer): chunks of every section's text under its header."""
    keys = edition.headers
    section = F.concat_ws(".", *[F.col(k).cast("string") for k in keys])
    g = marked_lines(edition, v).groupBy(section.alias("section"), *([F.col("mandala")] if "mandala" in keys else [])).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*edition.levels, "line"))), lambda x: x["line"]), "\n").alias("body")
    )
    header = F.concat(F.lit("#" * len(keys) + f" {edition.work} "), "section", F.lit("\n\n"), "body")
    layer: Column = layer_of(F.col("mandala")) if "mandala" in keys else F.lit(edition.layer).cast("int")
    whole = g.select("section", header.alias("text"), layer.alias("layer"))
    c = parse.chunk_documents(whole, "section", "text").join(whole.select("section", "layer"), "section")
    return c.select(F.lit(edition.name).alias("filename"), "section", "pos", "page_content", "layer")


def spot_checks(v: DataFrame, expected: dict[str, str]) -> DataFrame:
    """(address, wanted, found): whether the verse of an address holds a word."""
    want = v.sparkSession.createDataFrame(list(expected.items()), "address string, wanted string")
    return want.join(v.select("address", "text"), "address", "left").select("address", "wanted", F.coalesce(F.col("text").contains(F.col("wanted")), F.lit(False)).alias("found"))


def ingest(edition: Edition, landed: DataFrame, path: str, least: int = 1) -> dict[str, DataFrame]:
    """Verses, Markdown view, chunks, postings and lexicon of one edition as tables; the chunks of other editions at the path stay.

    Raises if fewer than `least` verses came out, before anything is replaced."""
    spark = landed.sparkSession
    base = f"{path}/{edition.name}"
    verses_of(edition, landed).write.mode("overwrite").parquet(f"{base}/verses")
    v = spark.read.parquet(f"{base}/verses")
    n = v.count()
    if n < least:
        raise ValueError(f"{edition.work}: {n} verses, at least {least} expected")
    markdown(edition, v).write.mode("overwrite").parquet(f"{base}/markdown")
    replace_partition(chunks_of(edition, v), f"{path}/chunks")
    c = spark.read.parquet(f"{path}/chunks").where(F.col("filename") == edition.name)
    search.postings(c.withColumn("chunk_key", F.concat_ws("#", "filename", "section", "pos")), "chunk_key", "page_content").write.mode("overwrite").parquet(f"{base}/postings")
    lexical.build_lexicon(v, "text", romanise=True).write.mode("overwrite").parquet(f"{base}/lexicon")
    return {t: spark.read.parquet(f"{base}/{t}") for t in ("verses", "markdown", "postings", "lexicon")} | {"chunks": c}


def hymn_index(lines: DataFrame, least: int = 1000) -> tuple[DataFrame, bool]:
    """(hymns, complete): the union of all mandalas' index files, and whether at least as many hymns came out as there should be."""
    hymns = parse.latest_hymns(parse.hymn_index(lines))
    return hymns, hymns.count() >= least


def unrepeated_pages(pages: DataFrame, verses: DataFrame) -> DataFrame:
    """verses(file, pos, text) of pages(file, page), those of the pages that are reached and whose verses no earlier page has in the same order."""
    from shabdagrid.sources.files import contiguous_files

    reached = contiguous_files(pages.select("file", "page").distinct(), "page")
    v = verses.join(reached.select("file"), "file", "left_semi")
    firsts = windows.first_files(v.withColumnRenamed("pos", "line_no"), "file", ["line_no"], "text")
    return v.join(firsts.where("file = first_file").select("file"), "file", "left_semi")
