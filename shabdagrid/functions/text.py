"""Column functions over text: scripts, accents, tokens, stems, small normalisers.  All stay in the JVM.

Every function maps null to null and '' to the value stated for it.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode has it, in a form that Java and RE2 read alike.
# For Spark the class is written with Java's own Unicode white space, which it tests much faster.
JAVA_WS = r"(?U)[\s\x{1C}-\x{1F}]+"
WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
DEVANAGARI = r"[\x{0900}-\x{097F}]"
IAST_LETTERS = "āīūṛṝḷḹṃḥśṣṭḍṅñ"
# Romanised letters and the plain letters that replace them.
IAST_PLAIN = {
    "ā": "a", "ī": "i", "ū": "u", "ṛ": "r", "ṝ": "r", "ḷ": "l", "ḹ": "l", "ē": "e", "ō": "o", "ṃ": "m", "ḥ": "h",
    "ṅ": "n", "ñ": "n", "ṇ": "n", "ṭ": "t", "ḍ": "d", "ś": "s", "ṣ": "s",
}
# The same for search keys, where some letters become two or none.
IAST_KEY = {"ṝ": "ri", "ṛ": "ri", "ḹ": "li", "ṃ": "m", "ṁ": "m", "ḥ": "", "ś": "sh", "ṣ": "sh", "ḷ": "l"}
# Endings of nouns, longest first.
NOUN_ENDINGS = ["asya", "enas", "aya", "ena", "ah", "am", "at", "au", "as", "a", "e"]
# Words that a keyword query drops.
QUESTION_WORDS = "summarize explain describe tell about what who when where why how is are the a an in on at for".split()
# Capitalised words that are no names.
NOT_NAMES = (
    "What When Where Which Who Whom Whose Why How I You He She It We They This That These Those And But Or Nor For Yet So If Then "
    "Because In On At By With From To Of Into Through During Before After Above Below Between Among The A An Is Are Was Were Be Been "
    "Being Have Has Had Do Does Did Will Would Could Should May Might Must Can War Wars Battle Battles King Kings Queen Queens Hymn "
    "Hymns Book Books Chapter Chapters Ten Twenty Thirty Forty Fifty Hundred Thousand Tell Explain Describe Name List Give Show Find "
    "All Some Any Each Every Both Either Neither Many Few Several Shall"
).split()


@lru_cache(maxsize=1)
def _bases() -> tuple[str, str]:
    """Precomposed letters and their base letters, from the Unicode decompositions."""
    src, dst = [], []
    for cp in [*range(0xC0, 0x2200), *range(0xF900, 0xFB50)]:
        d = unicodedata.normalize("NFD", chr(cp))
        if d != chr(cp) and unicodedata.category(d[0])[0] == "L":
            src.append(chr(cp))
            dst.append(d[0])
    return "".join(src), "".join(dst)


def strip_accents(c: Column) -> Column:
    """Canonical decomposition without its non-spacing marks."""
    return F.regexp_replace(F.translate(c, *_bases()), r"\p{Mn}", "")


def words(c: Column) -> Column:
    """Tokens parted at any Unicode white space; '' gives an empty array."""
    return F.array_remove(F.split(c, JAVA_WS), "")


def script_ratio(c: Column, first: int = 1000) -> Column:
    """Share of Devanagari in the first characters; 0 for ''."""
    head = F.substring(c, 1, first)
    n = F.length(head)
    return F.when(n == 0, F.lit(0.0)).otherwise((n - F.length(F.regexp_replace(head, DEVANAGARI, ""))) / n)


def contains_devanagari(c: Column) -> Column:
    """Whether more than a twentieth of the first thousand characters is Devanagari."""
    return script_ratio(c) > 0.05


def any_devanagari(c: Column) -> Column:
    return c.rlike(DEVANAGARI)


def contains_iast(c: Column) -> Column:
    return F.lower(c).rlike(f"[{IAST_LETTERS}]")


def is_english_query(c: Column) -> Column:
    """Neither Devanagari nor romanisation marks."""
    return ~any_devanagari(c) & ~contains_iast(c)


def remove_diacritics(c: Column) -> Column:
    """Romanised letters to ASCII, case kept."""
    src = "".join(IAST_PLAIN) + "".join(k.upper() for k in IAST_PLAIN)
    dst = "".join(IAST_PLAIN.values()) + "".join(v.upper() for v in IAST_PLAIN.values())
    return F.translate(c, src, dst)


def search_key(c: Column) -> Column:
    """Romanised or loosely typed word -> plain key: sibilants as sh, c as ch, ch as chh, letters a-z alone."""
    t = F.trim(F.lower(c))
    for k, v in IAST_KEY.items():
        t = F.replace(t, F.lit(k), F.lit(v))
    t = F.replace(F.replace(F.replace(t, F.lit("ch"), F.lit("\u0001")), F.lit("c"), F.lit("ch")), F.lit("\u0001"), F.lit("chh"))
    return F.regexp_replace(strip_accents(t), "[^a-z]", "")


def normalize_latin(c: Column) -> Column:
    return F.replace(strip_accents(F.lower(c)), F.lit("-"), F.lit(""))


def sandhi_variants(key: Column) -> Column:
    """The key, and what remains of it when its first vowel fuses with the word before."""
    n = F.length(key)
    rest = F.substring(key, 2, 1 << 20)
    return F.array_compact(
        F.array(
            key,
            F.when(key.startswith("i") & (n > 4), F.concat(F.lit("e"), rest)),
            F.when(key.startswith("u") & (n > 4), F.concat(F.lit("o"), rest)),
            F.when(key.startswith("a") & (n > 5), rest),
        )
    )


def romanisation_variants(c: Column) -> Column:
    """Candidate romanised forms of a popular spelling, the verbatim form first; short words stand alone."""
    t = F.trim(F.lower(c))
    rep = lambda x, a, b: F.replace(x, F.lit(a), F.lit(b))
    va = rep(rep(t, "ksh", "kṣ"), "sh", "ś")
    vb = rep(va, "ch", "c")
    return F.when(F.length(t) < 4, F.array(t)).otherwise(F.array_distinct(F.array(t, va, vb, rep(vb, "ri", "ṛ"), rep(t, "sh", "ṣ"))))


def strip_devanagari_marks(c: Column) -> Column:
    """Devanagari without vowel signs, nasalisation and accents."""
    return F.regexp_replace(c, r"[\x{0900}-\x{0903}\x{093C}-\x{094D}\x{0951}-\x{0954}]", "")


def fallback_tokens(c: Column) -> Column:
    """Tokens parted at white space, dandas and punctuation."""
    return F.array_remove(F.split(c, r"[\s।॥\-,.;:!?]+"), "")


def noun_stem(token: Column) -> Column:
    """The token without its longest noun ending, if more than two letters remain; else the next shorter ending is tried."""
    out = token
    for e in reversed(NOUN_ENDINGS):
        n = F.length(token) - len(e)
        out = F.when(F.lower(token).endswith(e) & (n > 2), F.substring(token, F.lit(1), n)).otherwise(out)
    return F.when(F.length(token) <= 2, token).otherwise(out)


def stems(tokens: Column) -> Column:
    return F.transform(tokens, noun_stem)


def preprocess(c: Column) -> Column:
    """Marks removed, tokenised, stemmed, joined by blanks."""
    return F.array_join(stems(fallback_tokens(strip_devanagari_marks(c))), " ")


def keyword_query(c: Column) -> Column:
    """Query for keyword search: question words out, accents and punctuation out, brackets and hyphens kept.

    Devanagari queries keep every character; what is left too short falls back to the query as typed.
    """
    kept = F.trim(F.regexp_replace(c, r"(?i)\b(" + "|".join(QUESTION_WORDS) + r")\b", ""))
    plain = F.trim(F.regexp_replace(strip_accents(kept), r"[^\p{L}\p{N}_\s\[\]\-]", ""))
    out = F.when(any_devanagari(c), kept).otherwise(plain)
    return F.when(F.length(out) < 2, c).otherwise(out)


def proper_nouns(c: Column) -> Column:
    """Capitalised words after the first that may be names, in order of first occurrence."""
    bare = F.transform(F.slice(words(c), 2, 1 << 20), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_]", ""))
    named = F.filter(bare, lambda w: (F.length(w) >= 3) & w.rlike(r"^\p{Lu}") & ~w.isin(NOT_NAMES) & (w != F.upper(w)))
    return F.array_distinct(named)


def dictionary_key(c: Column) -> Column:
    """Key of a dictionary term: accents marks, hyphens and punctuation out, lower case."""
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(c, r"[/\\-]", ""), "[।॥.,;:!?]", "")))


def key_terms(definition: Column) -> Column:
    """First five words of five or more letters outside tags and brackets."""
    t = F.regexp_replace(F.regexp_replace(definition, "<[^>]+>", ""), r"\([^)]+\)", "")
    ws = F.filter(F.regexp_extract_all(t, F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0)), lambda w: w.rlike("^[a-zA-Z]{5,}$"))
    stop = ["which", "there", "their", "about", "other", "being", "having", "called", "often"]
    return F.slice(F.filter(ws, lambda w: ~F.lower(w).isin(stop)), 1, 5)


# Code points of Vedic accents.
ACCENTS = r"[\x{0951}\x{0952}\x{1CD0}-\x{1CFF}\x{A8E0}-\x{A8FF}\x{0300}\x{0301}\x{0302}\x{0304}]"


def has_vedic_accents(c: Column) -> Column:
    return c.rlike(ACCENTS)


def accent_signature(c: Column) -> Column:
    """The accents of a text in their order."""
    return F.array_join(F.regexp_extract_all(c, F.lit(ACCENTS), F.lit(0)), "")


def clean_for_speech(c: Column) -> Column:
    """Words alone: verse markers, dandas, brackets and digits become blanks; a lost accent raises an error."""
    t = F.regexp_replace(F.regexp_replace(c, "॥[^॥]*॥", " "), r"[।॥|/\\\[\]{}()<>*_#0-9०-९]", " ")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.when(accent_signature(c).eqNullSafe(accent_signature(t)), t).otherwise(F.when(c.isNotNull(), F.raise_error(F.lit("accent marks were lost"))))


# What makes a question one about change over time, and one for all places.
DIACHRONIC = r"(?i)(earlier|early|later|late|older|newer)[^.?]*\b(vedic|veda|period|layer|mandala|time)|evolv|over time|diachronic|through time|chronolog"
ASKS = r"(?i)\b(which|what|where|list|all|every|how\s+many|find|show|give|tell|discuss|talk|about|search|name|enumerate|any)\b"
PLACES = r"(?i)\b(verse|verses|hymn|hymns|mention|mentions|mentioned|contain|contains|occur|occurs|appear|appears|talk|talks|reference|references|passage|passages)\b"


def is_diachronic(c: Column) -> Column:
    return c.rlike(DIACHRONIC)


def asks_for_all(c: Column) -> Column:
    """Whether a question asks where something occurs."""
    return c.rlike(ASKS) & c.rlike(PLACES)


def question_mode(c: Column) -> Column:
    """'diachronic', 'concordance' or 'plain'."""
    return F.when(is_diachronic(c), "diachronic").when(asks_for_all(c), "concordance").otherwise("plain")


def preprocess_for_embedding(c: Column) -> Column:
    """Marks removed and tokenised, no stems: the lighter form that is embedded.  '' for blank texts."""
    return F.array_join(fallback_tokens(strip_devanagari_marks(c)), " ")
