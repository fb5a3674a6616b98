"""Cleaners of edition transcriptions before transliteration; each is a chain of JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shabdagrid.functions.translit import to_devanagari

# Edition letters and their usual romanisation.
EDITION_LETTERS = {"ʰ": "h", "r\u0325": "ṛ", "R\u0325": "Ṛ", "l\u0325": "ḷ", "m\u0310": "ṃ", "M\u0310": "Ṃ"}


def edition_to_iast(c: Column) -> Column:
    """Raised h and letters with a ring below as romanisation has them."""
    for k, v in EDITION_LETTERS.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def strip_pitch(c: Column) -> Column:
    """Pitch accents out; length marks and dots stay."""
    return F.regexp_replace(F.translate(c, "áàâíìîúùûéèêóòôÁÀÂÍÌÎÚÙÛÉÈÊÓÒÔ", "aaaiiiuuueeeoooAAAIIIUUUEEEOOO"), r"[\x{300}\x{301}\x{302}]", "")


def strip_variants(c: Column) -> Column:
    """Variant readings in braces out, stray braces too."""
    return F.regexp_replace(F.regexp_replace(c, r"\{[A-Z][^}]*\}", ""), "[{}]", "")


def strip_labels(c: Column) -> Column:
    """Structural labels that ran into the text out."""
    return F.regexp_replace(c, r"(?:Book|Chapter|Paragraph|Verse|Sentence):\s*\d*(?:=?[a-z](?![a-z]))?", " ")


def strip_edition_marks(c: Column) -> Column:
    """Elision marks with their note numbers, line continuations and junction signs out; blanks collapsed."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"['՚]\d*", ""), r"\\|//", " "), "[=+]", "")
    return F.trim(F.regexp_replace(t, " {2,}", " "))


def strip_vedic_marks(c: Column) -> Column:
    """Combining marks of the Vedic blocks out of Devanagari."""
    return F.regexp_replace(c, r"[\x{1CD0}-\x{1CFF}\x{A8E0}-\x{A8FF}]", "")


def edition_to_devanagari(c: Column, accents: bool = False, variants: bool = False, labels: bool = False) -> Column:
    """The whole chain of one edition: which steps it needs is told by the flags."""
    t = edition_to_iast(c)
    t = strip_pitch(t) if accents else t
    t = strip_variants(t) if variants else t
    t = strip_labels(t) if labels else t
    return strip_vedic_marks(to_devanagari(strip_edition_marks(t)))
