"""Substring search with rarity guarantee, exhaustive concordance, and the corpus lexicon.

Terms are a short list of the question, so every test is a literal predicate on the scan; nothing is joined pairwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shabdagrid.functions.text import search_key
from shabdagrid.functions.translit import to_iast
from shabdagrid.lineage import cut

RARE_MIN, RARE_SHARE, RARE_TERMS = 50, 100, 6


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a term."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("long")


def lexical_scores(docs: DataFrame, id_col: str, text: str, terms: list[str]) -> DataFrame:
    """(id, matched, hits, score) of all documents with a term: a thousand for each distinct term, one for each occurrence."""
    t = F.col(text)
    matched = F.array_compact(F.array(*[F.when(t.contains(x), F.lit(x)) for x in terms]))
    hits = sum((occurrences(t, x) for x in terms), F.lit(0))
    d = docs.where(t.isNotNull()).select(id_col, matched.alias("matched"), hits.alias("hits")).where(F.size("matched") > 0)
    return d.withColumn("score", F.size("matched") * F.lit(1000).cast("long") + F.col("hits"))


def term_df(docs: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """(term, df) for every term, in one pass."""
    t = F.col(text)
    counted = docs.agg(*[F.count_if(t.contains(x)).alias(f"t{i}") for i, x in enumerate(terms)])
    pairs = F.array(*[F.struct(F.lit(x).alias("term"), F.coalesce(f"t{i}", F.lit(0)).alias("df")) for i, x in enumerate(terms)])
    return counted.select(F.explode(pairs).alias("p")).select("p.term", "p.df")


def rare_terms(docs: DataFrame, text: str, terms: list[str]) -> list[str]:
    """The rarest terms that occur at all, in order of rarity, then of the list."""
    n, *df = docs.agg(F.count(F.lit(1)), *[F.count_if(F.col(text).contains(x)) for x in terms]).first()
    limit = max(RARE_MIN, n // RARE_SHARE)
    return [x for _, _, x in sorted((d, i, x) for i, (x, d) in enumerate(zip(terms, df)) if 0 < d <= limit)[:RARE_TERMS]]


def lexical_hits(docs: DataFrame, id_col: str, text: str, terms: list[str], top_k: int = 5) -> DataFrame:
    """(id, score, pos): the top k, then the best document of each rare term that no earlier hit holds.

    The guarantee is sequential: a document appended for one rare term serves the terms after it.  It needs the best document
    by every combination of rare terms alone, of which there are at most 2 ** RARE_TERMS, and folds them on the driver.
    """
    scores = lexical_scores(docs, id_col, text, terms)
    rare = rare_terms(docs, text, terms) if terms else []
    top = [(r[id_col], r["score"], set(r["matched"])) for r in scores.orderBy(F.col("score").desc(), id_col).limit(top_k).collect()]
    chosen = {t[0] for t in top}
    if rare:
        which = F.array_intersect("matched", F.array(*[F.lit(x) for x in rare]))
        best = F.struct(F.col("score").alias("s"), (-F.col(id_col)).alias("n"))
        by = scores.where(F.size(which) > 0 if not chosen else (F.size(which) > 0) & ~F.col(id_col).isin(list(chosen)))
        pool = [(r["b"]["s"], -r["b"]["n"], set(r["w"])) for r in by.groupBy(F.array_sort(which).alias("w")).agg(F.max(best).alias("b")).collect()]
        for term in rare:
            if any(term in t[2] for t in top):
                continue
            for s, i, m in sorted(pool, key=lambda x: (-x[0], x[1])):
                if term in m and i not in chosen:
                    top.append((i, s, m))
                    chosen.add(i)
                    break
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    return spark.createDataFrame([(i, s, n) for n, (i, s, _) in enumerate(top)], f"{id_col} {kind}, score long, pos int")


VERSE_ID = r"॥\s*((?:[A-Z]{2,4} )?\d+\.\d+\.\d+)\s*॥"
STRICT_VERSE_ID = r"॥ (\d+\.\d+\.\d+) ॥"


def verse_lines(docs: DataFrame, text: str, pos: list[str], strict: bool = False) -> DataFrame:
    """(corpus, path, vid, line, pos) of all verse lines; the id ends the line.  Work prefixes are read unless `strict`."""
    lines = docs.select(*pos, F.posexplode(F.split(F.col(text), "\r?\n")).alias("_n", "_l"))
    vid = F.regexp_extract("_l", (STRICT_VERSE_ID if strict else VERSE_ID) + r"\s*$", 1)
    d = lines.select(*pos, "_n", F.trim("_l").alias("line"), vid.alias("vid")).where("vid != ''")
    path = F.transform(F.split(F.regexp_extract("vid", r"(\d+\.\d+\.\d+)$", 1), r"\."), lambda x: x.cast("int"))
    return d.withColumn("corpus", F.regexp_extract("vid", "^([A-Z]+)", 1)).withColumn("path", path)


def concordance(docs: DataFrame, text: str, terms: list[str], pos: list[str], limit: int | None = None, strict: bool = False) -> DataFrame:
    """(corpus, path, vid, line, total): every verse with a term, the first line of each id, in numeric order.

    `total` counts all verses even where the list is limited.  Documents without a term are dropped before their lines are read.
    """
    has = lambda c: F.lit(False) if not terms else F.col(c).rlike("|".join(r"\Q" + t + r"\E" for t in terms))
    v = verse_lines(docs.where(has(text)), text, pos, strict).where(has("line"))
    first = v.groupBy("corpus", "path", "vid").agg(F.min_by("line", F.struct(*pos, "_n")).alias("line"))
    first = cut(first, "concordance")  # listed and counted from one scan of the corpus
    out = first.withColumn("total", F.lit(first.count()))
    return out if limit is None else out.orderBy("corpus", "path").limit(limit)


def build_lexicon(docs: DataFrame, text: str, pattern: str = r"[\p{L}][\p{L}\p{M}]+", least: int = 3, romanise: bool = False) -> DataFrame:
    """(kind, key, tokens): search keys of all distinct tokens, and the same with sh as s; Devanagari is romanised first if asked."""
    token = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(pattern), F.lit(0))))
    tokens = docs.select(token.alias("token")).where(F.length("token") >= least).distinct()
    latin = to_iast(F.col("token")) if romanise else F.col("token")
    keyed = tokens.withColumn("_latin", latin).withColumn("key", search_key(F.col("_latin"))).where(F.length("key") >= least)
    both = keyed.select(F.lit("primary").alias("kind"), "key", "token").unionByName(
        keyed.select(F.lit("skeleton").alias("kind"), F.replace("key", F.lit("sh"), F.lit("s")).alias("key"), "token")
    )
    return both.groupBy("kind", "key").agg(F.sort_array(F.collect_set("token")).alias("tokens"))


def lexicon_lookup(lexicon: DataFrame, candidates: list[str], max_tokens: int = 12, max_keys: int = 6, per_key: int = 4) -> DataFrame:
    """(token, pos) for candidate keys: exact, then prefix, then inner matches, shortest keys first.

    Later modes count only while fewer than max_tokens are found.  Each (mode, candidate, kind) gives at most max_keys keys.
    """
    skel = [c.replace("sh", "s") for c in candidates]
    tests = []
    for m, mode in enumerate(("exact", "prefix", "infix")):
        for kind, cs in ((0, candidates), (1, skel)):
            for i, c in enumerate(cs):
                key = F.col("key")
                hit = {"exact": key == c, "prefix": key.startswith(c), "infix": key.contains(c)}[mode]
                right = F.col("kind") == ("primary", "skeleton")[kind]
                tests.append(F.when(hit & right, F.struct(F.lit(m).alias("mode"), F.lit(kind).alias("k"), F.lit(i).alias("c"))))
    h = lexicon.select("key", "tokens", F.explode(F.array_compact(F.array(*tests))).alias("t"))
    w = Window.partitionBy("t").orderBy(F.length("key"), "key")
    h = h.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_keys)
    tok = h.select("t", "_r", F.posexplode(F.slice("tokens", 1, per_key)).alias("_p", "token"))
    first = tok.groupBy("token").agg(F.min(F.struct("t.mode", "t.k", "t.c", "_r", "_p")).alias("o"))
    by_mode = first.groupBy("o.mode").count()
    w2 = Window.orderBy("mode").rowsBetween(Window.unboundedPreceding, -1)
    live = by_mode.withColumn("_before", F.coalesce(F.sum("count").over(w2), F.lit(0))).where(F.col("_before") < max_tokens).select("mode")
    kept = first.join(F.broadcast(live), first["o.mode"] == live["mode"]).select("token", "o").orderBy("o").limit(max_tokens)
    return kept.select("token", (F.row_number().over(Window.orderBy("o")) - 1).alias("pos"))
