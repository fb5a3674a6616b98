"""Answering: a bounded state machine on the driver.  The model is any callable from prompt to text, tools are callables by name.

classify and plan -> tools (dictionary, grammar, corpus) -> synthesis -> evaluation -> refinement, at most a fixed number of times.
"""

from __future__ import annotations

import os
import re
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shabdagrid.functions import questions as Q

Model = Callable[[str], str]
Tools = dict[str, Callable]
SYNTHESIS_DOCS, SYNTHESIS_CHARS, EXAMPLES = 12, 500, 5
THRESHOLD, REFINEMENTS, CALL_DELAY = 7, 1, 0.65
# Phrases by which the planner tells what kind of question it is.
PLAN_CONSTRUCTION = ["how do i say", "translate", "in sanskrit", "sanskrit for", "how to say", "say in sanskrit", "sanskrit word for", "construct", "write in sanskrit"]
PLAN_GRAMMAR = ["explain", "what is the rule", "how does", "declension", "conjugation"]
# Where the words to be translated stand in a question, tried in this order after a quotation.
WORDS_AT = [r"translate\s+([^?]+?)(?:\s+in|\s+to|$)", r"say\s+([^?]+?)(?:\s+in|$)", r"how do i say\s+([^?]+?)(?:\s+in|$)", r"sanskrit for\s+([^?]+?)(?:\?|$)"]
# Words of such a question that are not to be translated.
NOT_TRANSLATED = "do i say in sanskrit to the a an me can please vedic translate".split()
FIRST_TOOL = {"construction": "dictionary", "grammar": "grammar", "factual": "corpus"}
NEXT_TOOL = {"dictionary": "grammar", "grammar": "corpus", "corpus": "synthesize"}
NOUNS_OF_DECLENSION = ["milk", "water", "fire"]


def plan_type(c: Column, pinned: Column | None = None) -> Column:
    """construction, grammar or factual by the planner's phrases; a pinned verse makes a question factual."""
    return Q.query_type(c, pinned, PLAN_CONSTRUCTION, PLAN_GRAMMAR)


def words_to_translate(c: Column) -> Column:
    """The English words of a construction question, an empty array for any other question."""
    low = F.lower(c)
    quoted = F.lower(F.regexp_extract(c, r"['\"]([^'\"]+)['\"]", 1))
    parts = [F.when(low.rlike(p), F.trim(F.regexp_extract(low, p, 1))) for p in WORDS_AT]
    text = F.coalesce(F.when(quoted != "", quoted), *[F.nullif(p, F.lit("")) for p in parts], low)
    ws = F.split(F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}_\s]", " "), r"\s+")
    kept = F.filter(ws, lambda w: (F.length(w) > 2) & ~w.isin(NOT_TRANSLATED))
    return F.when(Q.mentions(c, PLAN_CONSTRUCTION), kept).otherwise(F.when(c.isNotNull(), F.array().cast("array<string>")))


def next_tool(kind: Column) -> Column:
    return reduce(lambda e, x: F.when(kind == x[0], x[1]).otherwise(e), FIRST_TOOL.items(), F.lit(None).cast("string"))


@dataclass
class State:
    question: str
    query_type: str = ""
    english_words: list[str] = field(default_factory=list)
    next_action: str = ""
    translations: dict[str, list[str]] = field(default_factory=dict)
    grammar: list[tuple[str, str]] = field(default_factory=list)
    passages: list[tuple[str, str]] = field(default_factory=list)
    pinned: str | None = None
    facts: str = ""
    answer: str = ""
    score: float = -1
    refinements: int = 0
    messages: list[str] = field(default_factory=list)


def plan(question: str, pinned: str | None = None) -> State:
    """The state a question starts in; the predicates are those of the columns, on one local row."""
    from pyspark.sql import SparkSession

    one = SparkSession.getActiveSession().createDataFrame([(question,)], "q string")
    kind = plan_type(F.col("q"), F.lit(pinned is not None))
    r = one.select(kind.alias("kind"), words_to_translate(F.col("q")).alias("words"), next_tool(kind).alias("next")).first()
    return State(question, r["kind"], list(r["words"]), r["next"], pinned=pinned, messages=[f"planned: {question}"])


def execute(state: State, tools: Tools) -> State:
    """One tool step: dictionary(word) -> terms, grammar(term, context) -> text, corpus(query) -> labelled passages, expand(question) -> terms."""
    if state.next_action == "dictionary":
        state.translations = {w: list(tools["dictionary"](w)) for w in state.english_words} if "dictionary" in tools else {}
    elif state.next_action == "grammar" and "grammar" in tools:
        for word, terms in state.translations.items():
            if terms:
                state.grammar.append((word, tools["grammar"](terms[0], "declension" if word in NOUNS_OF_DECLENSION else "conjugation")))
    elif state.next_action == "corpus":
        query = state.question
        if state.query_type == "construction":
            query = ", ".join(t for ts in state.translations.values() for t in ts) + " example sentence usage"
        elif state.query_type == "factual" and state.pinned is None and "expand" in tools:
            query = " ".join([query, *tools["expand"](state.question)])
        state.passages = list(tools["corpus"](query))
    state.messages.append(state.next_action)
    state.next_action = NEXT_TOOL.get(state.next_action, "synthesize")
    return state


def corpus_examples(corpus: Callable[[str], list[tuple[str, str]]], terms: str, pattern: str = "") -> str:
    """The first passages for terms, or for example sentences of a pattern, parted by blank lines."""
    found = corpus(f"{terms} {pattern} example sentence usage" if pattern else terms)
    return "\n\n".join(t for _, t in found[:EXAMPLES]) or "No relevant passages found in corpus."


def evidence(hits: list[tuple[str, str]]) -> str:
    """Labelled passages of the synthesis budget."""
    return "\n\n".join(f"{label}:\n{text[:SYNTHESIS_CHARS]}" for label, text in hits[:SYNTHESIS_DOCS])


def prompt(state: State) -> str:
    """What the model is asked, by the type of the question: translations and grammar for construction, rules for grammar, facts and
    passages for the rest; a pinned verse goes first."""
    parts = [f"[{state.query_type}] {state.question}"]
    parts += [f"PINNED VERSE:\n{state.pinned}"] if state.pinned else []
    if state.query_type == "construction":
        parts += ["TRANSLATIONS:\n" + "\n".join(f"{w}: {', '.join(t) or '-'}" for w, t in state.translations.items())] if state.translations else []
    if state.query_type in ("construction", "grammar"):
        parts += ["GRAMMAR:\n" + "\n".join(f"{w}: {t}" for w, t in state.grammar)] if state.grammar else []
    parts += [state.facts] if state.facts and state.query_type == "factual" else []
    return "\n\n".join([*parts, evidence(state.passages)])


def after_synthesis(state: State, evaluates: bool) -> str:
    return "evaluate" if evaluates and state.query_type == "factual" else "end"


def after_evaluation(state: State, most: int = REFINEMENTS, threshold: float = THRESHOLD) -> str:
    return "refine" if 0 <= state.score < threshold and state.refinements < most else "end"


def should_continue(state: State) -> str:
    return {"synthesize": "synthesize"}.get(state.next_action, "execute" if state.next_action in NEXT_TOOL else "end")


def score_of(text: str) -> float:
    """The number in an evaluation, -1 without one."""
    m = re.search(r"\d+(?:\.\d+)?", text)
    return float(m.group()) if m else -1


def run(question: str, tools: Tools, model: Model, pinned: str | None = None, facts: str = "", evaluate: Model | None = None, refinements: int = REFINEMENTS) -> State:
    """The whole machine.  Refusals are neither evaluated nor refined."""
    state = plan(question, pinned)
    state.facts = facts
    while should_continue(state) == "execute":
        state = execute(state, tools)
    state.answer = model(prompt(state))
    while after_synthesis(state, evaluate is not None) == "evaluate" and not any(p in state.answer.lower() for p in Q.REFUSAL):
        state.score = score_of(evaluate(f"{state.question}\n\n{state.answer}"))
        if after_evaluation(state, refinements) == "end":
            break
        state.answer = model(f"{prompt(state)}\n\nDRAFT:\n{state.answer}\n\nImprove it.")
        state.refinements += 1
    return state


def citations(state: State) -> list[str]:
    return [c for c, _ in state.passages[:SYNTHESIS_DOCS]]


def rate_limited(model: Model, delay: float = CALL_DELAY) -> Model:
    """The model with at least `delay` seconds between the starts of its calls, from whichever thread."""
    lock, last = threading.Lock(), [0.0]

    def call(text: str) -> str:
        with lock:
            time.sleep(max(0.0, last[0] + delay - time.monotonic()))
            last[0] = time.monotonic()
        return model(text)

    return call


_shared: dict[str, object] = {}
_shared_lock = threading.Lock()


def shared(name: str, build: Callable[[], object]) -> object:
    """One instance per process, built when first asked for."""
    with _shared_lock:
        if name not in _shared:
            _shared[name] = build()
        return _shared[name]


def setting(name: str, default=None, secrets: dict | None = None, cast: Callable | None = None):
    """A configuration value: environment, then secrets, then the default; a value that cannot be cast gives the default."""
    raw = os.environ.get(name) or (secrets or {}).get(name)
    if raw in (None, ""):
        return default
    try:
        return (lambda v: str(v).strip().lower() in ("1", "true", "yes", "on"))(raw) if cast is bool else cast(raw) if cast else raw
    except (TypeError, ValueError):
        return default
