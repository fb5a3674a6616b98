"""Predicates over questions and answers; word lists are parameters with the usual values as defaults."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that decide what kind of question it is, in the order of the tests.
CONSTRUCTION = ["how do i say", "translate to sanskrit", "what is", "in sanskrit", "how to say", "say in vedic", "sanskrit for", "vedic word for", "translate", "in devanagari", "construct"]
GRAMMAR = ["explain", "what is the rule", "how does", "why", "grammar", "declension", "conjugation", "sandhi", "vibhakti", "case ending", "verb form", "how to form"]
LOCATION = ["where", "location", "place", "river", "cross", "dwell", "lived", "live", "settled", "settlement", "bank"]
TRIBAL = ["tribe", "enemy", "enemies", "ally", "allies", "fought with", "fought against", "confederat", "coalition", "ten kings"]
FOLLOW_UP = [
    "this verse", "that verse", "the verse", "this line", "that line", "this hymn", "that hymn", "this reading", "your reading",
    "your interpretation", "you said", "you interpret", "why do you", "why did you", "how do you", "justif", "differ", "instead of", "epithet",
    "proper noun", "not a name", "same verse", "translate it", "interpret it", "its meaning", "the meaning", "word-by-word", "word by word",
    "sandhi", "grammar", " it ", " its ",
]
REFUSAL = ["do not have enough information", "couldn't find relevant information", "could not find relevant information", "not found in the available corpus"]
GRAMMAR_SIGNS = ["declension", "conjugation", "case", "ending", "vibhakti", "suffix"]


def mentions(c: Column, phrases: list[str]) -> Column:
    """Whether a phrase occurs anywhere, case ignored; null for null."""
    low = F.lower(c)
    return reduce(lambda a, b: a | b, [low.contains(p) for p in phrases])


def query_type(c: Column, pinned: Column | None = None, construction: list[str] = CONSTRUCTION, grammar: list[str] = GRAMMAR) -> Column:
    """construction, grammar or factual, in this order; a pinned verse makes a question factual."""
    kind = F.when(mentions(c, construction), "construction").when(mentions(c, grammar), "grammar").otherwise("factual")
    return kind if pinned is None else F.when(pinned, "factual").otherwise(kind)


def is_follow_up(c: Column, phrases: list[str] = FOLLOW_UP) -> Column:
    return mentions(c, phrases)


def is_refusal(answer: Column, phrases: list[str] = REFUSAL) -> Column:
    return mentions(answer, phrases)


def keyword_expansion(c: Column, rules: list[tuple[list[str], list[str]]]) -> Column:
    """Names added by every rule whose keywords the question mentions, distinct, in order."""
    empty = F.array().cast("array<string>")
    added = [F.when(mentions(c, keys), F.array(*[F.lit(n) for n in names])).otherwise(empty) for keys, names in rules]
    return F.array_distinct(F.flatten(F.array(*added)))


def grammar_passages(hits, text: str, pos: str, top: int = 2, chars: int = 500):
    """The first hits that hold a sign of grammar, cut for display."""
    kept = hits.where(mentions(F.col(text), GRAMMAR_SIGNS)).orderBy(pos).limit(top)
    return kept.withColumn(text, F.substring(text, 1, chars))


def model_terms(answer: Column, most: int = 20, longest: int = 30) -> Column:
    """Search terms in a model's comma- or line-separated answer: romanised letters alone, not too long, distinct."""
    raw = F.slice(F.filter(F.transform(F.split(answer, r"[,\n;]+"), lambda x: F.trim(x)), lambda x: x != ""), 1, most)
    bare = F.transform(raw, lambda x: F.regexp_replace(F.regexp_replace(x, "[^A-Za-zāīūṛṝḷḹṃḥśṣṭḍṇñṅ-]", ""), "^-+|-+$", ""))
    return F.array_distinct(F.filter(bare, lambda x: (x != "") & (F.length(x) <= longest)))


def first_object(answer: Column) -> Column:
    """The first JSON object in a text, null without one."""
    return F.nullif(F.regexp_extract(answer, r"(?s)\{.*?\}", 0), F.lit(""))
