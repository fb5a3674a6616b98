"""Problem 9: pages of repeated keywords, links, tags, products or menu items.

Method: the rank-frequency curve of every page (log frequency over log rank, each token weighing one) is fitted by least squares with
SQL windows and held against prose in the same language and of comparable length:
- slope: the page's slope less the usual one;
- residual: how far the page's points lie above the usual curve on average, over ln n, the most that is possible;
- divergence: Kullback-Leibler divergence of the page's shares of frequent words, of links and of other words from the usual shares.
  Frequent words are the FREQUENT words of a language that most of its pages have, counted over the whole corpus.
A page is flagged where one of the three is extreme: outside the middle of the language's pages by more than a multiple of the
distance between their quartiles, and by more than chance gives a page of its length.

What is usual at a length is a parabola in log n for each language, through the medians of slope, intercept and shares of the length
classes.  Medians and quartiles come from fixed-width histograms over all pages: exact to the bin, whatever the order of rows, and no page
is too short to be counted or judged.  They stand for prose as long as fewer than a quarter of a language's pages are stuffed.

The language of a page is told from its letters (lang is missing or odd too often): Devanagari, Latin with many diacritics and hardly any
function word, other Latin, other scripts.  Every link, address, anchor tag and hashtag is one and the same word.

Defined results: null, empty and blank texts have no words and give no row.  A page of one or two links is too little to tell.
Cost: the words of a page are computed once and written to the shared folder; what is shuffled is the vocabulary, combined before, and a
handful of (frequency, number of words) pairs a page.  To the driver come FREQUENT words and some hundred medians for each of four languages.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shabdagrid.lineage import Scratch

FREQUENT = 40
LINK_SHARE = 0.02  # share of links that prose may have
# Multiples of the distance between the quartiles.  Three is the usual bound for far-out values; shares and slopes have long tails in prose.
FAR_RESIDUAL, FAR_DIVERGENCE, FAR_SLOPE = 3.0, 12.0, 8.0
SURE_RESIDUAL, SURE_DIVERGENCE = 8.0, 20.0  # least sum of residuals over the tokens, least likelihood ratio 2 n D
LEAST_SPREAD = 0.005
BINS, LENGTH_DEGREE = 4000, 2
LANGUAGES = ("deva", "iast", "latin", "other")
# Function words of English, by which it is told from romanised text.
FUNCTION_WORDS = (
    "a an and any are as at be been but by can could did do does for from had has have he her his how i if in into is it its "
    "may no nor not of on one or our she should so some such than that the their them then there these they this "
    "those to us was we were what when where whether which while who whose why will with would you your"
)
LINK = (
    r"<[a-z]++\s++href=[^>\s]*+|</?[a-z]++>|(?:https?://|www\.)\S++|#[\p{L}\p{N}_][\p{L}\p{M}\p{N}_]*+"
    r"|(?<![a-z0-9.-])[a-z0-9-]++(?:\.[a-z0-9-]++)++(?<=\.[a-z]{3,24})(?:/\S*+)?"
)
MARK = "\u0001"


def page_words(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id_col, w, n, n_link, language): the sorted words of every page that has one."""
    plain = F.regexp_replace(F.lower(F.col(text).cast("string")), LINK, f" {MARK} ")
    words = F.array_remove(F.split(plain, rf"[^\p{{L}}\p{{M}}\p{{N}}{MARK}‌‍]+"), "")
    t = df.select(id_col, words.alias("w"))
    among = lambda test: F.size(F.filter("w", test)).cast("long")
    latin = lambda x: ((x >= "a") & (x < "\u0250")) | ((x >= "\u1e00") & (x < "\u1f00"))
    t = t.select(
        id_col,
        F.sort_array("w").alias("w"),
        F.size("w").cast("long").alias("n"),
        among(lambda x: x.isin(FUNCTION_WORDS.split())).alias("n_function"),
        among(lambda x: x == MARK).alias("n_link"),
        among(lambda x: (x >= "\u0900") & (x < "\u0980")).alias("n_deva"),
        among(lambda x: latin(x) & (F.octet_length(x) > F.length(x))).alias("n_iast"),
        among(latin).alias("n_latin"),
    )
    return t.select(id_col, "w", "n", "n_link", language().alias("language"))


def frequent_words(pages: DataFrame, most: int = FREQUENT) -> dict[str, list[str]]:
    """The words that most pages of a language have, numbers and links apart; ties go to the smaller word."""
    each = pages.select("language", F.explode(F.array_distinct("w")).alias("t")).where(F.col("t").rlike(r"\p{L}"))
    df = each.groupBy("language", "t").agg(F.count(F.lit(1)).alias("df")).withColumn("s", F.pmod(F.xxhash64("t"), F.lit(64)))
    order = [F.col("df").desc(), "t"]
    some = df.withColumn("r", F.row_number().over(Window.partitionBy("language", "s").orderBy(*order))).where(F.col("r") <= most)
    top = some.withColumn("r", F.row_number().over(Window.partitionBy("language").orderBy(*order))).where(F.col("r") <= most)
    out: dict[str, list[str]] = {x: [] for x in LANGUAGES}
    for row in top.orderBy("language", "r").collect():
        out[row["language"]].append(row["t"])
    return out


def page_points(pages: DataFrame, id_col: str, frequent: dict[str, list[str]]) -> DataFrame:
    """One row per page and frequency f: the number c of its words that occur f times."""
    among = lambda ws: F.size(F.filter("w", lambda x: x.isin(ws)))
    share = F.lit(0)
    for lang, ws in frequent.items():
        if ws:
            share = F.when(F.col("language") == lang, among(ws)).otherwise(share)
    t = pages.withColumn("n_frequent", share.cast("long"))
    starts = F.filter(F.sequence(F.lit(0), F.size("w")), lambda i: (i == 0) | ~F.get("w", i).eqNullSafe(F.get("w", i - 1)))
    t = t.withColumn("_s", starts)
    runs = F.zip_with(F.slice("_s", 1, F.size("_s") - 1), F.slice("_s", 2, F.size("_s")), lambda a, b: b - a)
    keys = [id_col, "n", "n_frequent", "n_link", "language"]
    return t.select(*keys, F.explode(runs).alias("f")).groupBy(*keys, "f").agg(F.count(F.lit(1)).alias("c"))


def language() -> Column:
    """The language class of a page from the letters its words have."""
    share = lambda c: F.col(c) / F.greatest(F.lit(1), F.col("n"))
    return (
        F.when(share("n_deva") > 0.4, "deva")
        .when((share("n_iast") > 0.45) & (share("n_function") < 0.12), "iast")
        .when(share("n_latin") + share("n_link") > 0.4, "latin")
        .otherwise("other")
    )


def fit_curves(points: DataFrame, id_col: str) -> DataFrame:
    """Slope and intercept of every page's rank-frequency curve, with the mean log rank mx and log frequency my of its tokens.

    Words of equal frequency share a run of ranks, which stands at its geometric middle.
    """
    w = Window.partitionBy(id_col).orderBy(F.col("f").desc())
    upto = F.sum("c").over(w)
    p = points.withColumn("x", 0.5 * (F.log(upto - F.col("c") + 1) + F.log(upto))).withColumn("y", F.log(F.col("f").cast("double")))
    c, x, y = F.col("c") * F.col("f"), F.col("x"), F.col("y")
    s = lambda e, n: F.sum(e).alias(n)
    g = p.groupBy(id_col, "n", "n_frequent", "n_link", "language").agg(
        s("c", "distinct_words"), s(c * x, "sx"), s(c * y, "sy"), s(c * x * x, "sxx"), s(c * x * y, "sxy")
    )
    n = F.col("n")
    vx, vxy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("sxy") - F.col("sx") * F.col("sy") / n
    g = g.withColumn("slope", F.when(vx > 1e-9, vxy / vx).otherwise(0.0))
    return g.select(
        id_col, "n", "n_frequent", "n_link", "language", "distinct_words", "slope", ((F.col("sy") - F.col("slope") * F.col("sx")) / n).alias("intercept"),
        (F.col("sx") / n).alias("mx"), (F.col("sy") / n).alias("my"), (F.col("n_frequent") / n).alias("share"), F.log(n.cast("double")).alias("ln"),
    )


def quantiles(rows: DataFrame, keys: list[str], values: dict[str, tuple[Column, float, float]], at: list[float]) -> DataFrame:
    """(keys, measure, rows, q): quantiles of values(name -> (value, lowest, highest)) from histograms of BINS bins."""
    cell = lambda v, lo, hi: F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((v - lo) / (hi - lo) * BINS))).cast("int")
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), cell(*v).alias("bin")) for m, v in values.items()]))
    h = rows.select(*keys, each.alias("e")).groupBy(*keys, "e.measure", "e.bin").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(*keys, "measure")
    h = h.withColumn("upto", F.sum("k").over(w.orderBy("bin"))).withColumn("all", F.sum("k").over(w))
    first = lambda p: F.min(F.when(F.col("upto") >= p * F.col("all"), F.col("bin")))
    g = h.groupBy(*keys, "measure").agg(F.max("all").alias("rows"), F.array(*[first(p) for p in at]).alias("b"))
    span = F.create_map(*[x for m, (_, lo, hi) in values.items() for x in (F.lit(m), F.struct(F.lit(lo).alias("lo"), F.lit((hi - lo) / BINS).alias("step")))])
    here = span[F.col("measure")]
    return g.select(*keys, "measure", "rows", F.transform("b", lambda b: (b + 0.5) * here["step"] + here["lo"]).alias("q"))


def usual(pages: DataFrame) -> dict[str, Column]:
    """What is usual for the language and length of a page: the fitted medians of slope, intercept and share of frequent words."""
    of_class = pages.withColumn("lc", F.round(F.log2(F.col("n").cast("double"))))
    spans = {"slope": (F.col("slope"), -8.0, 2.0), "intercept": (F.col("intercept"), 0.0, 20.0), "share": (F.col("share"), 0.0, 1.0)}
    medians = quantiles(of_class, ["language", "lc"], spans, [0.5]).collect()  # four languages, one class for each doubling of the length
    out = {}
    for m in spans:
        value = F.lit(0.0)
        for lang in LANGUAGES:
            at = sorted((r["lc"], r["q"][0], r["rows"]) for r in medians if r["language"] == lang and r["measure"] == m)
            if not at:
                continue
            x, y, k = (np.array(v, dtype=float) for v in zip(*at))
            fit = np.polyfit(x, y, min(LENGTH_DEGREE, len(at) - 1), w=np.sqrt(k))
            curve = F.lit(0.0)
            for c in fit:
                curve = curve * (F.col("ln") / float(np.log(2))) + F.lit(float(c))
            value = F.when(F.col("language") == lang, curve).otherwise(value)
        out[m] = value
    return out


def judge_pages(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Every page that has a word, with its measures and `stuffed`."""
    scratch = Scratch(df.sparkSession, "stuffing")
    words = scratch.cut(page_words(df, id_col, text))
    pages = scratch.cut(fit_curves(page_points(words, id_col, frequent_words(words)), id_col))
    expected = usual(pages)
    p = pages.select("*", *[v.alias(f"u_{m}") for m, v in expected.items()])
    part = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    q, links = F.least(F.lit(0.98), F.greatest(F.lit(LINK_SHARE), F.col("u_share"))), F.col("n_link") / F.col("n")
    rest = F.greatest(F.lit(0.0), 1 - F.col("share") - links)
    p = p.select(
        id_col, "language", "n", "distinct_words", "slope", (F.col("slope") - F.col("u_slope")).alias("d_slope"),
        F.when(F.col("n") > 1, (F.col("my") - F.col("u_intercept") - F.col("u_slope") * F.col("mx")) / F.col("ln")).otherwise(0.0).alias("residual"),
        (part(F.col("share"), q) + part(links, F.lit(LINK_SHARE)) + part(rest, 1 - q)).alias("divergence"),
        ((F.col("share") < F.col("u_share")) | (links > LINK_SHARE)).alias("less_prose"), "ln",
    )
    spans = {"d_slope": (F.col("d_slope"), -4.0, 4.0), "residual": (F.col("residual"), -1.0, 1.0), "divergence": (F.col("divergence"), -0.5, 3.5)}
    middle = {(r["language"], r["measure"]): r["q"] for r in quantiles(p, ["language"], spans, [0.25, 0.5, 0.75]).collect()}

    def far(m: str) -> Column:
        """Distance from the median in units of the distance between the quartiles."""
        z = F.lit(0.0)
        for lang in LANGUAGES:
            if (lang, m) in middle:
                lo, mid, hi = middle[lang, m]
                z = F.when(F.col("language") == lang, (F.col(m) - mid) / max(hi - lo, LEAST_SPREAD)).otherwise(z)
        return z

    n = F.col("n")
    bad = (
        ((far("residual") > FAR_RESIDUAL) & (F.col("residual") * F.col("ln") * n > SURE_RESIDUAL))
        | (F.col("less_prose") & (far("divergence") > FAR_DIVERGENCE) & (2 * n * F.col("divergence") > SURE_DIVERGENCE))
        | ((F.abs(far("d_slope")) > FAR_SLOPE) & (F.col("residual") * F.col("ln") * n > SURE_RESIDUAL))
    )
    return p.select(
        id_col, "language", "n", "distinct_words", "slope", far("d_slope").alias("far_slope"), "residual", far("residual").alias("far_residual"),
        "divergence", far("divergence").alias("far_divergence"), bad.alias("stuffed"),
    )
