"""Citations in free text: patterns are data, tried in order; the first that matches gives the label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, in the order in which they are tried: pattern and the label its groups make.
PATTERNS: list[tuple[str, str]] = [
    (r"\[(\d{2})-(\d{3})\]\s+(?:HYMN|BOOK|CANTO)", "RV {i1}.{i2}"),
    (r"(?:Hymn|RV|Rigveda)\s+(\d+)\.(\d+)(?:\.(\d+))?", "RV {1}.{2}{.3}"),
    (r"VS[A-Z]*\s+(\d+)\.(\d+)", "YV {1}.{2}"),
    (r"(?:YV|Yajurveda|Verse)\s+(\d+)\.(\d+)", "YV {1}.{2}"),
    (r"PBr\.\s+([0-9]+|[IVX]+)\s*\.\s*(\d+)(?:\s*\.\s*(\d+))?", "PB {r1}.{2}{.3}"),
    (r"^\s*(\d+)\.\s+(?:By means of|They|The|At|This)", "PB Section {1}"),
    (r"(?:Satapatha|SB|Brahmana)\s+(\d+)\.(\d+)\.(\d+)(?:\.(\d+))?", "SB {1}.{2}.{3}{.4}"),
    (r"(?:Mantra|Sukta|Adhyaya)\s+(\d+)", "Unknown Reference"),
    (r"^#+\s*(?:Hymn|Verse|Sutra|Section|Book|Mandala)\s+(\d+)(?:[:\-]\s*(.+))?", "Hymn {1}{ (2)}"),
    (r"(?:Book|Canto|Adhyaya)\s+([IVX]+|\d+)", "Book {1}"),
]
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def roman_to_int(c: Column) -> Column:
    """Value of a Roman numeral; null where another character occurs, 0 for ''."""
    values = F.create_map(*[x for k, v in ROMAN.items() for x in (F.lit(k), F.lit(v))])
    nums = F.transform(F.array_remove(F.split(c, ""), ""), lambda ch: values[ch])
    signed = F.transform(nums, lambda x, i: F.when(x < F.coalesce(F.get(nums, i + 1), F.lit(0)), -x).otherwise(x))
    return F.when(c.rlike("^[IVXLCDM]*$"), F.aggregate(signed, F.lit(0), lambda a, x: a + x))


def _label(text: Column, pattern: str, label: str) -> Column:
    rx = "(?im)" + pattern
    g = lambda n: F.regexp_extract(text, rx, n)
    parts: list[Column] = []
    rest = label
    while "{" in rest:
        before, _, tail = rest.partition("{")
        spec, _, rest = tail.partition("}")
        if before:
            parts.append(F.lit(before))
        digit = int("".join(ch for ch in spec if ch.isdigit()))
        if spec.startswith("i"):
            parts.append(g(digit).cast("int").cast("string"))
        elif spec.startswith("r"):
            parts.append(F.when(g(digit).rlike("^[IVX]+$"), roman_to_int(g(digit)).cast("string")).otherwise(g(digit)))
        elif spec.startswith("."):
            parts.append(F.when(g(digit) != "", F.concat(F.lit("."), g(digit))).otherwise(""))
        elif spec.startswith(" ("):
            parts.append(F.when(g(digit) != "", F.concat(F.lit(" ("), g(digit), F.lit(")"))).otherwise(""))
        else:
            parts.append(g(digit))
    if rest:
        parts.append(F.lit(rest))
    return F.when(text.rlike(rx), F.concat(*parts))


def verse_reference(text: Column, patterns: list[tuple[str, str]] = PATTERNS) -> Column:
    """Label of the first reference in a text, null without one.  Book, canto and verse marks of epics are combined first."""
    book = F.regexp_extract(text, r"#\s+Book\s+([IVX]+)\.", 1)
    canto = F.regexp_extract(text, r"(?m)##\s+Canto\s+([IVXLC]+)\.\s+.+?(?:\.|$)", 1)
    verse = F.regexp_extract(text, r"\[(\d{3})\]", 1)
    part = lambda v, name, n: F.when(v != "", F.concat(F.lit(name), n.cast("string")))
    epic = F.concat_ws(", ", part(book, "Book ", roman_to_int(book)), part(canto, "Canto ", roman_to_int(canto)), part(verse, "Verse ", F.try_to_number(verse, F.lit("999")).cast("int")))
    return F.coalesce(F.when(epic != "", F.concat(F.lit("Ramayana "), epic)), *[_label(text, p, f) for p, f in patterns])


def section_title(text: Column) -> Column:
    """Title of the section a text opens with: a bracketed name list, else the first header."""
    names = F.regexp_extract(text, r"(?i)\[Names\s*\([^)]*\):\s*([^\]]+)\]", 1)
    head = F.regexp_extract(text, r"(?im)^#+\s*(?:Hymn|Verse|Sutra|Section)?\s*[\d:]*\s*(.+?)$", 1)
    return F.coalesce(F.when(names != "", F.trim(F.split(names, ",")[0])), F.when(head != "", F.trim(head)))


def from_metadata(meta: dict[str, Column]) -> Column:
    """Citation from metadata columns: a stored reference, else hymn of a mandala, else verse of an adhyaya, an unknown upper level as '?'."""
    c = lambda n: meta[n].cast("string") if n in meta else F.lit(None).cast("string")
    two = lambda work, upper, lower: F.when(c(lower).isNotNull(), F.concat(F.lit(work + " "), F.coalesce(c(upper), F.lit("?")), F.lit("."), c(lower)))
    return F.coalesce(c("verse_reference"), two("RV", "mandala", "hymn_number"), two("YV", "adhyaya", "verse_number"))


def citation_label(text: Column, stored: Column, passage_no: Column) -> Column:
    """The stored citation, else one from the first 500 characters, with the section title; else 'Passage n'."""
    cite = F.coalesce(stored, verse_reference(F.substring(text, 1, 500)))
    return F.when(cite.isNull(), F.concat(F.lit("Passage "), passage_no.cast("string"))).otherwise(F.concat_ws(" - ", cite, section_title(text)))


def url_fragment(label: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(label), " .", "--"), "[^a-z0-9-]", "")


def display_passage(text: Column, label: Column, chars: int = 500) -> Column:
    """Label and the first characters of a passage, as shown; the row keeps the whole text."""
    return F.concat(label, F.lit(":\n"), F.substring(text, 1, chars))


def citation_block(hits, text: str, label: str, pos: str = "pos", chars: int = 500):
    """One row: the passages of a result list with their labels, in order, parted by blank lines."""
    shown = F.struct(F.col(pos).alias("p"), display_passage(F.col(text), F.col(label), chars).alias("t"))
    return hits.agg(F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["t"]), "\n\n").alias("block"))


def citation_list(hits, label: str, source: str, pos: str = "pos"):
    """One row per passage of a result list: its label, source, number from 0, and the fragment it can be linked by."""
    return hits.select(F.col(label).alias("citation"), F.coalesce(F.col(source), F.lit("Unknown")).alias("source"), F.col(pos).alias("chunk_index"), url_fragment(F.col(label)).alias("url_fragment"))
