"""Problem 6: link the spellings under which people enter one person.

Method: MinHash banding over padded q-grams proposes candidates, Monge-Elkan similarity verifies them, star clustering groups
them.  BANDS and ROWS follow from the collision curve: a family name of eleven letters keeps a Jaccard similarity of about 0.4
of its padded bigrams under two typing errors, and banding() gives the smallest number of bands whose recall there is the target.

A name is parsed once per distinct spelling: titles, clans in brackets and places are set aside, joined names parted, order and script
habits (long vowels, aspirates, w/v, sh/s, y/i, a final a) folded, the given name found in the list of given names and
their short forms.  What is compared are distinct (given name, family form) pairs, never rows.

- Full names and short names: candidates share the given name and a band.  In a bucket of at most CROWD forms everyone is compared with
  everyone.  The forms of larger buckets meet over what is left of them when as many letters are left out as may differ: all pairs
  that agree meet there and few others, so such a bucket costs what its likenesses cost.  Forms too long for that are compared with their whole bucket.
- A given name that the list does not have, or that is a typing error of several of its names, is tried with the centres of listed names
  whose family name agrees, and joins the one whose given name agrees best, if no second agrees as well.
- Initials and cut-off family names are held against the centres of the stars and linked only if exactly one person fits; initials that fit
  nobody stand for one person of their own, those that fit several are left alone.
- Who fits no centre, of these and of the given names before, is held against all other members of the stars in the same way.

Defined results: null and blank names, and names without a family name, are linked with nothing.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shabdagrid.lineage import Scratch
from shabdagrid.llm.visual_form import consistent_form
from shabdagrid.operators.skew import spread, with_group

Q, ROWS, TYPO_JACCARD, RECALL = 2, 3, 0.4, 0.99
FINE_ROWS = 4  # rows of a band where only the family name's initial company narrows the candidates
AGREE = 0.89  # least Monge-Elkan similarity of (given name, family name)
STRAY_AGREE = 0.85  # the same where the given name is not in the list and one person has to fit best
PREFIX = 4
CROWD = 8  # largest bucket in which all pairs are compared; beyond it letters left out cost less
SPARED_MAX = 18  # longest form whose letters are left out: three of them, 988 forms
LISTED_MAX = 200_000
# Titles that are no part of a name.
TITLES = set("king queen prince princess raja rani maharaja sri shri acharya maharshi rishi sage seer guru the".split())
_MERSENNE = (1 << 31) - 1


def banding(similarity: float = TYPO_JACCARD, rows: int = ROWS, recall: float = RECALL) -> int:
    """Bands b so that 1 - (1 - s^r)^b reaches the recall at this similarity."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


BANDS = banding()
_rng = np.random.default_rng(6)
_A = _rng.integers(1, _MERSENNE, BANDS * ROWS, dtype=np.int64)
_B = _rng.integers(0, _MERSENNE, BANDS * ROWS, dtype=np.int64)
FINE_BANDS = banding(rows=FINE_ROWS)
_FINE_A = _rng.integers(1, _MERSENNE, FINE_BANDS * FINE_ROWS, dtype=np.int64)
_FINE_B = _rng.integers(0, _MERSENNE, FINE_BANDS * FINE_ROWS, dtype=np.int64)


def fold(token: str) -> str:
    """One form for the habits in which people write the same sounds."""
    t = "".join(c for c in unicodedata.normalize("NFD", token.lower()) if not unicodedata.combining(c))
    t = t.replace("ee", "i").replace("oo", "u").replace("w", "v").replace("y", "i")
    t = re.sub(r"([bcdfgjkpst])h", r"\1", t)
    t = re.sub(r"(.)\1+", r"\1", t)
    return t[:-1] if len(t) > 3 and t.endswith("a") else t


def edit_distance(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance (insert, delete, change, swap neighbours); most + 1 where it exceeds `most`."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


def token_similarity(a: str, b: str) -> float:
    n = max(len(a), len(b), 1)
    most = max(1, n // 4)
    d = edit_distance(a, b, most)
    return 0.0 if d > most else 1 - d / n


def monge_elkan(a: list[str], b: list[str]) -> float:
    """Mean over the tokens of either side of the best match on the other; the smaller of the two directions."""
    if not a or not b:
        return 0.0
    one = lambda p, q: sum(max(token_similarity(x, y) for y in q) for x in p) / len(p)
    return min(one(a, b), one(b, a))


def bands(form: str) -> tuple[list[int], list[int]]:
    """Band hashes of the padded q-grams of a form, in bands of ROWS and of FINE_ROWS."""
    padded = "^" * (Q - 1) + form + "$" * (Q - 1)
    grams = np.array(sorted({zlib.crc32(padded[i : i + Q].encode()) for i in range(len(padded) - Q + 1)}), dtype=np.int64) % _MERSENNE

    def cut(a: np.ndarray, b: np.ndarray, rows: int) -> list[int]:
        low = ((grams[:, None] * a + b) % _MERSENNE).min(axis=0).tobytes()
        return [zlib.crc32(low[i : i + 8 * rows]) for i in range(0, len(low), 8 * rows)]

    return cut(_A, _B, ROWS), cut(_FINE_A, _FINE_B, FINE_ROWS)


def _shorter(t: str) -> set[str]:
    return {t[:i] + t[i + 1 :] for i in range(len(t))}


def spared(form: str) -> set[str]:
    """What is left of a form without any letters up to the number that may differ at AGREE.

    Every change, swap, insertion or deletion is undone by leaving out one letter at most on either side, so two forms that agree
    have something in common here.
    """
    out = last = {form}
    for _ in range(math.floor((2 - 2 * AGREE) * len(form) + 1e-9)):
        last = {d for t in last for d in _shorter(t)}
        out = out | last
    return out


def _initial(t: str) -> str:
    """The first letter as it is typed in an abbreviation."""
    return unicodedata.normalize("NFD", t.lower())[:1].replace("w", "v")


class Parser:
    """Parts a spelling into given name, initial and family form."""

    def __init__(self, given: dict[str, tuple[str, str]], aside: set[str]) -> None:
        """given: folded given and short names -> (folded given name, its initial); aside: folded names of clans and places."""
        self.given, self.aside = given, aside
        self.less: list[dict[str, set[str]]] = [{g: {g} for g in given if len(g) >= 5}, {}, {}]
        for k in (1, 2):
            for form, sources in self.less[k - 1].items():
                for d in _shorter(form):
                    self.less[k].setdefault(d, set()).update(g for g in sources if len(g) >= (5 if k == 1 else 7))

    def find(self, token: str) -> tuple[str, str] | None:
        """The listed given name for a folded token: exactly, else the only one within one typing error, else within two."""
        if token in self.given:
            return self.given[token]
        mine = {token}
        for most in (1, 2):
            if len(token) < (4, 7)[most - 1]:
                break
            mine |= {d for m in mine for d in _shorter(m)}
            near = {g for m in mine for less in self.less[: most + 1] for g in less.get(m, ())}
            hits = {self.given[g] for g in near if edit_distance(token, g, most) <= most}
            if hits:
                return hits.pop() if len(hits) == 1 else None
        return None

    def __call__(self, name: str) -> tuple[str | None, str | None, str | None, bool, bool]:
        """(given name, initial, family form, family cut off, given name listed)."""
        t = consistent_form(name)
        t = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", t)
        t = re.sub(r"(?i)\s+of\s+\S.*$", " ", t)
        t = re.sub(r"(?<=[^\W\d_]{3})(?<![A-Z])(?=[A-Z][^\W\d_]{3})", " ", t)
        raw = re.findall(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ'’])*\.?", t)
        raw = [w for w in raw if w.rstrip(".").lower() not in TITLES]
        if len(raw) > 2:
            kept = [w for w in raw if fold(w.rstrip(".")) not in self.aside]
            raw = kept if len(kept) >= 2 else raw
        if len(raw) < 2:
            return None, None, None, False, False
        short = [w for w in raw if len(w.rstrip(".")) == 1]
        if short:
            rest = [w for w in raw if len(w.rstrip(".")) > 1]
            if not rest:
                return None, None, None, False, False
            fam = max(rest, key=len)
            return None, _initial(short[0]), fold(fam.rstrip(".")), False, False
        forms = [fold(w.rstrip(".")) for w in raw]
        found = [(i, self.given[f]) for i, f in enumerate(forms) if f in self.given]
        if not found:
            found = [(i, g) for i, f in enumerate(forms) if (g := self.find(f))]
        if found:
            at, (g, initial) = found[0]
        else:
            at = min(range(len(forms)), key=lambda i: (len(forms[i]), i))
            g, initial = forms[at], _initial(raw[at])
        others = [i for i in range(len(forms)) if i != at]
        fam = others[0] if len(others) == 1 else next((i for i in others if i == at + 1), others[0])
        return g, initial, forms[fam], raw[fam].endswith("."), bool(found)


def listed_names(spark_table: DataFrame) -> tuple[dict[str, tuple[str, str]], set[str]]:
    """Given names with their short forms, and clans and places, from the reference list of proper nouns.

    The list is a dictionary of fixed size; one that exceeds LISTED_MAX rows is refused rather than sent to every worker.
    """
    rows = spark_table.select("category", "canonical", "variants").where("canonical is not null").limit(LISTED_MAX + 1).collect()
    if len(rows) > LISTED_MAX:
        raise ValueError("the list of proper nouns is too large to be broadcast")
    given: dict[str, set[tuple[str, str]]] = {}
    aside = set()
    for r in rows:
        forms = [fold(v) for v in [r["canonical"], *(r["variants"] or [])] if v]
        if r["category"] == "given_name":
            for f in forms:
                given.setdefault(f, set()).add((fold(r["canonical"]), _initial(r["canonical"])))
        elif r["category"] in ("tribe", "place"):
            aside |= set(forms)
    return {f: next(iter(g)) for f, g in given.items() if len(g) == 1}, aside


def parse_names(names: DataFrame, given: dict[str, tuple[str, str]], aside: set[str]) -> DataFrame:
    """names(name) with given, initial, family, cut and the band hashes of the family form."""
    kind = T.StructType.fromDDL("given string, initial string, family string, cut boolean, listed boolean, bands array<bigint>, fine array<bigint>")
    lists = names.sparkSession.sparkContext.broadcast((given, aside))

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parser = Parser(*lists.value)
        memo: dict[str, tuple[list[int], list[int]]] = {}
        for s in batches:
            out = []
            for n in s:
                g, i, fam, cut, listed = parser(n) if n is not None else (None, None, None, False, False)
                if fam is not None and fam not in memo:
                    if len(memo) > 100_000:
                        memo.clear()
                    memo[fam] = bands(fam)
                out.append((g, i, fam, cut, listed, *(memo[fam] if fam is not None else (None, None))))
            yield pd.DataFrame(out, columns=["given", "initial", "family", "cut", "listed", "bands", "fine"])

    # Not declared deterministic, or the filter would be pushed below the aggregate and parse every mention.
    return names.withColumn("p", run.asNondeterministic()("name")).select("name", "p.*").where("family is not null and family != ''")


@F.pandas_udf(T.DoubleType())
def _agreement(given_a: pd.Series, fam_a: pd.Series, given_b: pd.Series, fam_b: pd.Series) -> pd.Series:
    return pd.Series([monge_elkan([p, x], [q, y]) for p, x, q, y in zip(given_a, fam_a, given_b, fam_b)])


def agreeing(pairs: DataFrame) -> DataFrame:
    """pairs(given, family, other, ...) with sim, of at least AGREE.

    Where both given names are equal the family names must agree to 2 * AGREE - 1; a swap of neighbours is two plain edits, so
    a bounded plain distance in the JVM rules out most pairs, and none that would agree, before they are deduplicated and
    before any Python runs.
    """
    n = F.greatest(F.length("family"), F.length("other"))
    most = 2 * math.ceil((2 - 2 * AGREE) * 40)
    near = pairs.withColumn("_d", F.levenshtein("family", "other", most)).where((F.col("_d") >= 0) & (F.col("_d") <= 2 * F.floor((2 - 2 * AGREE) * n + 1e-9)) | (n > 40)).drop("_d")
    given = F.coalesce("given", F.lit(""))
    return spread(near.distinct()).withColumn("sim", _agreement.asNondeterministic()(given, "family", given, "other")).where(F.col("sim") >= AGREE)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _spared(family: pd.Series) -> pd.Series:
    return pd.Series([[zlib.crc32(t.encode()) for t in spared(f)] for f in family])


def candidates(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """pairs(v, given, family, w, other), each in one direction and possibly repeated, of forms(v, given, family, bands) that share given name and band."""
    h = F.posexplode("bands").alias("band", "h")
    shared = with_group(forms.select("v", "given", "family", h), ["given", "band", "h"], "v", {}, at_least=2)
    shared = scratch.cut(shared.select("v", "given", "family", "band", "h", "group_rows"))
    left = lambda df: df.select("v", "given", "family", "band", "h")
    right = lambda df: df.select("given", F.col("v").alias("w"), F.col("family").alias("other"), "band", "h")
    few, many = shared.where(F.col("group_rows") <= CROWD), shared.where(F.col("group_rows") > CROWD)
    columns = ["v", "given", "family", "w", "other"]
    pairs = left(few).join(right(few), ["given", "band", "h"]).where("v < w").select(columns)
    if many.isEmpty():
        return pairs
    crowd = scratch.cut(many.select("v", "given", "family").distinct())
    letters = spread(crowd.where(F.length("family") <= SPARED_MAX)).withColumn("k", _spared.asNondeterministic()("family"))
    keyed = scratch.cut(letters.select("v", "given", "family", F.explode("k").alias("k")))
    others = keyed.select("given", F.col("v").alias("w"), F.col("family").alias("other"), "k")
    pairs = pairs.unionByName(keyed.join(others, ["given", "k"]).where("v < w").select(columns))
    long = left(many.where(F.length("family") > SPARED_MAX)).join(right(many), ["given", "band", "h"]).where(F.col("v") != F.col("w"))
    once = (F.length("other") <= SPARED_MAX) | (F.col("v") < F.col("w"))
    return pairs.unionByName(long.where(once).select(columns))


def _tried(sought: DataFrame, people: DataFrame) -> DataFrame:
    """Pairs of sought(initial, family, stray, fine) and people(initial, family, given, star, fine) that share initial and a fine band."""
    a = sought.select("initial", "family", "stray", F.posexplode("fine").alias("band", "h"))
    b = people.select("initial", F.col("family").alias("other"), "given", "star", F.posexplode("fine").alias("band", "h"))
    # Most pairs of a band do not agree: a plain distance wider than either test allows rules them out before they are shuffled once more.
    n = F.greatest(F.length("family"), F.length("other"))
    near = (F.levenshtein("family", "other") <= 2 * F.greatest(F.lit(1), F.floor(n / 4))) | (n > 40)
    return a.join(b, ["initial", "band", "h"]).where(near).select("stray", "initial", "family", "other", "star", "given").distinct()


def _of_initials(tried: DataFrame) -> DataFrame:
    """(initial, family, s, t): smallest and largest person that fits."""
    fits = agreeing(tried.where("stray is null").drop("stray"))
    return fits.groupBy("initial", "family").agg(F.min("star").alias("s"), F.max("star").alias("t"))


def _best_of_strays(tried: DataFrame) -> DataFrame:
    """(stray, form, home): the person of every stray given name with a family form that fits; null where two persons agree equally well."""
    n, m = F.greatest(F.length("family"), F.length("other")), F.greatest(F.length("stray"), F.length("given"))
    near = tried.where((F.levenshtein("stray", "given") <= 2 * F.greatest(F.lit(1), F.floor(m / 4))) & (F.levenshtein("family", "other") <= 2 * F.greatest(F.lit(1), F.floor(n / 4))))
    sim = near.withColumn("sim", _agreement.asNondeterministic()("stray", "family", "given", "other")).where(F.col("sim") >= STRAY_AGREE)
    best = sim.groupBy("stray", "family", "star").agg(F.max("sim").alias("sim"))
    top = best.groupBy("stray", "family").agg(F.max("sim").alias("top"))
    same = best.join(top, ["stray", "family"]).where("sim = top").groupBy("stray", "family").agg(F.min("star").alias("home"), F.count(F.lit(1)).alias("k"))
    return same.select("stray", F.col("family").alias("form"), F.when(F.col("k") == 1, F.col("home")).alias("home"))


@F.pandas_udf(T.BooleanType())
def _begins(cut: pd.Series, family: pd.Series) -> pd.Series:
    return pd.Series([f.startswith(c) or len(c) >= PREFIX and edit_distance(c, f[: len(c)], 1) <= 1 for c, f in zip(cut, family)])


def _heads(form: Column, shorter: bool) -> Column:
    """Keys of which two forms share one if the first PREFIX letters differ by at most one typo; with `shorter`, also all shorter prefixes."""
    head = F.substring(form, 1, PREFIX)
    less = [F.concat(F.substring(head, 1, i), F.substring(head, i + 2, PREFIX)) for i in range(PREFIX)]
    few = [F.when(F.length(form) >= n, F.concat(F.lit("."), F.substring(form, 1, n))) for n in range(1, PREFIX)] if shorter else []
    return F.array_distinct(F.array_compact(F.array(head, *less, *few)))


def _of_cut(cut: DataFrame, people: DataFrame) -> DataFrame:
    """(given, family, s, t): smallest and largest person whose family name begins like a cut-off one; k are its heads."""
    heads = people.select("given", F.col("family").alias("other"), "star", F.explode(_heads(F.col("family"), True)).alias("k"))
    met = cut.select("given", "family", F.explode("k").alias("k")).distinct().join(heads, ["given", "k"])
    # a swap of neighbours is two plain edits
    close = met.where(F.levenshtein("family", F.substring(F.col("other"), F.lit(1), F.length("family")), 2) >= 0).select("given", "family", "other", "star").distinct()
    begun = close.withColumn("_b", _begins.asNondeterministic()("family", "other")).where("_b").withColumn("_x", F.col("other").startswith(F.col("family")))
    # who fits without a typo goes before who fits with one
    first = begun.groupBy("given", "family", "_x").agg(F.min("star").alias("s"), F.max("star").alias("t"))
    return first.groupBy("given", "family").agg(F.max_by(F.struct("s", "t"), "_x").alias("f")).select("given", "family", "f.s", "f.t")


def star_clusters(scratch: Scratch, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, star): greedy star clustering of nodes(v, weight) by edges(a, b, sim).

    In each round every undecided vertex that outranks its undecided neighbours (by weight, degree, then name) becomes the centre
    of a star; undecided neighbours of centres join the most similar of them.  Ranks are total, so the result is the
    same in any order, and every round decides at least the highest vertex of each component.
    """
    both = scratch.cut(edges.select("a", "b", "sim").union(edges.select(F.col("b"), F.col("a"), "sim")).where("a != b").groupBy("a", "b").agg(F.max("sim").alias("sim")))
    degree = both.groupBy(F.col("a").alias("v")).agg(F.count(F.lit(1)).alias("degree"))
    rank = F.struct(F.col("weight"), F.col("degree"), F.col("v"))
    todo = scratch.cut(nodes.join(degree, "v").select("v", rank.alias("rank")))
    done = [nodes.join(degree, "v", "left_anti").select("v", F.col("v").alias("star"))]
    while not todo.isEmpty():
        live = both.join(todo.select(F.col("v").alias("a"), F.col("rank").alias("ra")), "a").join(todo.select(F.col("v").alias("b"), F.col("rank").alias("rb")), "b")
        beaten = live.groupBy(F.col("a").alias("v")).agg(F.max(F.col("rb") > F.col("ra")).alias("beaten"))
        centre = scratch.cut(todo.join(beaten, "v", "left").where("coalesce(beaten, false) = false").select("v"))
        near = both.join(centre.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.max_by("b", F.struct("sim", "b")).alias("star"))
        joined = todo.join(centre, "v", "left_anti").join(near, "v").select("v", "star")
        decided = scratch.cut(centre.select("v", F.col("v").alias("star")).union(joined))
        done.append(decided)
        todo = scratch.cut(todo.join(decided, "v", "left_anti"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return scratch.cut(out)


def link_names(names: DataFrame, proper_nouns: DataFrame) -> DataFrame:
    """(name, person) for every distinct name of names(name) that has a family name; person is null where several fit."""
    scratch = Scratch(names.sparkSession, "names")
    counted = names.where("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("uses"))
    parsed = scratch.cut(parse_names(spread(counted.select("name")), *listed_names(proper_nouns)).join(counted, "name"))
    key = F.concat_ws(" ", "given", "family")
    whole = parsed.where("given is not null and not cut").withColumn("v", key)
    forms = scratch.cut(whole.groupBy("v", "given", "initial", "family").agg(F.sum("uses").alias("weight"), F.max("listed").alias("listed"), F.first("bands").alias("bands"), F.first("fine").alias("fine")))
    pairs = candidates(scratch, forms)
    edges = agreeing(pairs)
    stars = star_clusters(scratch, forms.select("v", "weight"), scratch.cut(edges.select(F.col("v").alias("a"), F.col("w").alias("b"), "sim")))
    star_of = forms.join(stars, "v")
    every = scratch.cut(star_of.where("v = star").select("star", "given", "initial", "family", "listed", "fine"))
    centres, strays = every.where("listed"), every.where("not listed")
    members = star_of.where("v != star").drop("listed").join(centres.select("star"), "star").select("star", "given", "initial", "family", "fine")

    initials = parsed.where("given is null").groupBy("initial", "family").agg(F.first("fine").alias("fine"))
    sought = initials.select("initial", "family", F.lit(None).cast("string").alias("stray"), "fine").unionByName(strays.select("initial", "family", F.col("given").alias("stray"), "fine"))
    tried = scratch.cut(_tried(sought, centres))
    person_of, of_initial = scratch.cut(_best_of_strays(tried.where("stray is not null"))), scratch.cut(_of_initials(tried))
    fitted = of_initial.select("initial", "family", F.lit(None).cast("string").alias("stray")).unionByName(strays.join(person_of, (F.col("given") == F.col("stray")) & (F.col("family") == F.col("form"))).select("initial", "family", "stray"))
    same = "l.initial <=> r.initial and l.family = r.family and l.stray <=> r.stray"
    alone = scratch.cut(sought.alias("l").join(fitted.alias("r"), F.expr(same), "left_anti"))
    again = scratch.cut(_tried(alone, members))
    person_of, of_initial = person_of.unionByName(_best_of_strays(again.where("stray is not null"))), of_initial.unionByName(_of_initials(again))
    own = F.concat(F.lit("."), "initial", F.lit(" "), "family")
    person = F.when(F.col("s").isNull(), own).when(F.col("s") == F.col("t"), F.col("s"))
    by_initial = parsed.where("given is null").join(of_initial, ["initial", "family"], "left").select("name", person.alias("person"))

    cut = parsed.where("given is not null and cut").withColumn("k", F.when(F.length("family") < PREFIX, F.array(F.concat(F.lit("."), "family"))).otherwise(_heads(F.col("family"), False)))
    of_cut = scratch.cut(_of_cut(cut, centres))
    of_cut = of_cut.unionByName(_of_cut(cut.join(of_cut, ["given", "family"], "left_anti"), members))
    by_cut = cut.join(of_cut, ["given", "family"], "left").select("name", F.when(F.col("s").isNull(), F.concat(key, F.lit("."))).when(F.col("s") == F.col("t"), F.col("s")).alias("person"))

    homes = strays.join(person_of, (strays["given"] == person_of["stray"]) & (strays["family"] == person_of["form"])).select("star", "home")
    by_whole = whole.join(stars, "v").join(homes, "star", "left").select("name", F.coalesce("home", "star").alias("person"))
    return scratch.cut(by_whole.unionByName(by_initial).unionByName(by_cut))


def spelling_pairs(linked: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a the smaller: every two spellings of one person.

    All pairs are the result asked for.  A person's spellings are spread by a salt on one side, so that a person with
    very many of them is not one task's work.
    """
    known = linked.where("person is not null")
    salts = 16
    left = known.select("person", F.col("name").alias("name_a"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s"))
    right = known.select("person", F.col("name").alias("name_b"), F.pmod(F.xxhash64("name"), F.lit(salts)).cast("int").alias("s"))
    return left.join(right, ["person", "s"]).where("name_a < name_b").select("name_a", "name_b")
