"""Devanagari <-> romanisation, table-driven, as Arrow functions once per distinct value of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of the two scripts in their traditional order.
VOWELS = dict(zip("a ā i ī u ū ṛ ṝ ḷ ḹ e ai o au".split(), "अ आ इ ई उ ऊ ऋ ॠ ऌ ॡ ए ऐ ओ औ".split()))
SIGNS = dict(zip("ā i ī u ū ṛ ṝ ḷ ḹ e ai o au".split(), "ा ि ी ु ू ृ ॄ ॢ ॣ े ै ो ौ".split()))
CONSONANTS = dict(
    zip(
        "k kh g gh ṅ c ch j jh ñ ṭ ṭh ḍ ḍh ṇ t th d dh n p ph b bh m y r l v ś ṣ s h ḻ".split(),
        "क ख ग घ ङ च छ ज झ ञ ट ठ ड ढ ण त थ द ध न प फ ब भ म य र ल व श ष स ह ळ".split(),
    )
)
OTHERS = {"ṃ": "ं", "ṁ": "ं", "ḥ": "ः", "'": "ऽ", "|": "।", "||": "॥", **dict(zip("0123456789", "०१२३४५६७८९"))}
VIRAMA = "्"
_TO_LATIN = {v: k for k, v in OTHERS.items() if k not in ("ṁ", "'")} | {"ऽ": "'"}
_DEVA_CONSONANT = {v: k for k, v in CONSONANTS.items()}
_DEVA_SIGN = {v: k for k, v in SIGNS.items()}
_DEVA_VOWEL = {v: k for k, v in VOWELS.items()}


def devanagari(text: str) -> str:
    """Romanised text in Devanagari; characters outside the tables stay."""
    if not text or any("ऀ" <= c <= "ॿ" for c in text):
        return text
    low, out, i, open_ = text.lower(), [], 0, False
    while i < len(low):
        two, one = low[i : i + 2], low[i]
        c = two if two in CONSONANTS else one if one in CONSONANTS else None
        if c:
            out.append((VIRAMA if open_ else "") + CONSONANTS[c])
            open_, i = True, i + len(c)
            continue
        v = two if two in VOWELS else one if one in VOWELS else None
        if v:
            out.append(SIGNS.get(v, "") if open_ else VOWELS[v])
            open_, i = False, i + len(v)
            continue
        if open_:
            out.append(VIRAMA)
            open_ = False
        o = two if two in OTHERS else one
        out.append(OTHERS.get(o, text[i : i + len(o)]))
        i += len(o)
    return "".join(out) + (VIRAMA if open_ else "")


def romanised(text: str) -> str:
    """Devanagari text in romanisation; text without Devanagari stays."""
    if not text or not any("ऀ" <= c <= "ॿ" for c in text):
        return text
    out, open_ = [], False
    for ch in text:
        if open_ and ch in _DEVA_SIGN:
            out.append(_DEVA_SIGN[ch])
            open_ = False
            continue
        if open_ and ch == VIRAMA:
            open_ = False
            continue
        if open_:
            out.append("a")
            open_ = False
        if ch in _DEVA_CONSONANT:
            out.append(_DEVA_CONSONANT[ch])
            open_ = True
        else:
            out.append(_DEVA_VOWEL.get(ch, _DEVA_SIGN.get(ch, _TO_LATIN.get(ch, ch))))
    return "".join(out) + ("a" if open_ else "")


def plain(text: str) -> str:
    from shabdagrid.functions.text import IAST_PLAIN

    return text.translate({ord(k): v for k, v in IAST_PLAIN.items()} | {ord(k.upper()): v.upper() for k, v in IAST_PLAIN.items()})


def query_variants(q: str) -> list[str]:
    """Spellings of a query in both scripts, longest first, ties by value."""
    out = {q}
    if any("ऀ" <= c <= "ॿ" for c in q):
        for x in (romanised(q), plain(romanised(q))):
            out |= {x, x.lower(), x.capitalize()}
    elif any(c in "āīūṛṝḷḹṃḥśṣṭḍṅñṇ" for c in q.lower()):
        out |= {devanagari(q), q.lower(), q.capitalize(), plain(q), plain(q).lower()}
    else:
        out |= {devanagari(q), q.lower(), q.capitalize()}
    return sorted((v for v in out if v.strip()), key=lambda v: (-len(v), v))


def _per_distinct(f, kind):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            done = {t: f(t) for t in s.dropna().unique()}
            yield pd.Series([done.get(t) for t in s], dtype=object)

    # Not declared deterministic, or a filter on the result would compute it twice.
    return F.pandas_udf(run, kind).asNondeterministic()


def to_devanagari(c: Column) -> Column:
    return _per_distinct(devanagari, T.StringType())(c)


def to_iast(c: Column) -> Column:
    return _per_distinct(romanised, T.StringType())(c)


def normalize_query(c: Column) -> Column:
    return _per_distinct(query_variants, T.ArrayType(T.StringType()))(c)


def expanded(q: str) -> str:
    """Every word of a query with all its spellings, in order."""
    return " ".join(v for w in q.split() for v in query_variants(w))


def expand_query(c: Column) -> Column:
    return _per_distinct(expanded, T.StringType())(c)


def keep_accents(text: str) -> str:
    """Devanagari of a romanised text; the text as it is where accent marks would be lost."""
    marks = [ch for ch in text if ch in _ACCENT_MARKS]
    out = devanagari(text)
    return text if marks and not any(ch in _ACCENT_MARKS for ch in out) else out


_ACCENT_MARKS = {chr(c) for c in (0x951, 0x952, 0x300, 0x301, 0x302, 0x304, *range(0x1CD0, 0x1D00), *range(0xA8E0, 0xA900))}
# The blocks of the two scripts are laid out alike: a letter of one stands 0x380 after that of the other.
_KANNADA = {c: c + 0x380 for c in [*range(0x902, 0x904), *range(0x905, 0x90D), *range(0x90E, 0x911), *range(0x912, 0x929), *range(0x92A, 0x931), *range(0x932, 0x934),
            *range(0x935, 0x93A), *range(0x93D, 0x945), *range(0x946, 0x949), *range(0x94A, 0x94E), 0x960, 0x961, *range(0x966, 0x970)]}


def kannada(text: str) -> str:
    """Kannada of a Devanagari or romanised text; Kannada stays."""
    return text if any("\u0c80" <= c <= "\u0cff" for c in text) else keep_accents(text).translate(_KANNADA)


def to_devanagari_with_accents(c: Column) -> Column:
    return _per_distinct(keep_accents, T.StringType())(c)


def to_kannada(c: Column) -> Column:
    return _per_distinct(kannada, T.StringType())(c)
