"""Keyword and vector search, rank fusion, boosts, source filters and unions of result lists.

Plans scan the corpus once, filter to query terms before anything is exploded, and end in TakeOrderedAndProject; only result
lists of at most k rows meet in windows without partitions.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shabdagrid.functions.text import words

K1, B, EPSILON = 1.5, 0.75, 0.25
SEMANTIC_WEIGHT, KEYWORD_WEIGHT = 0.7, 0.3
TOP_K, EXPANSION = 15, 1
QUERY_BLOCK, VECTOR_BLOCK = 256, 8192


def postings(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, term, tf, dl) of a corpus: the table that repeated keyword searches should be run on."""
    t = docs.where(F.col(text).isNotNull()).select(id_col, words(F.col(text)).alias("_w"))
    e = t.select(id_col, F.size("_w").alias("dl"), F.explode("_w").alias("term"))
    return e.groupBy(id_col, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, id_col: str, text: str, query: str | list[str], k: int | None = TOP_K) -> DataFrame:
    """(id, score) by Okapi BM25 with k1 1.5, b 0.75 and a floor of a quarter of the mean idf for terms in most documents.

    Null texts are no documents; empty ones count with length 0.  A term repeated in the query counts as often.  Ties go to the lower id.
    Document frequencies are combined on the map side; the mean idf needs those of the whole vocabulary.
    """
    wanted = Counter(query.split() if isinstance(query, str) else query)
    none = docs.limit(0).select(id_col, F.lit(0.0).alias("score"))
    t = docs.where(F.col(text).isNotNull()).select(id_col, text, words(F.col(text)).alias("_w"))
    n, mean_dl, *found = t.agg(F.count(F.lit(1)), F.avg(F.size("_w")), *[F.count_if(F.array_contains("_w", w)) for w in wanted]).first()
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in zip(wanted, found) if d}
    if not idf:
        return none
    if min(idf.values()) < 0:  # only then is the vocabulary needed
        df = t.select(F.explode(F.array_distinct("_w")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        (mean_idf,) = df.agg(F.avg(F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))).first()
        idf = {w: v if v >= 0 else EPSILON * mean_idf for w, v in idf.items()}
    norm = K1 * (1 - B + B * F.size("_w") / F.lit(float(mean_dl)))
    # every term's frequency is counted inside the row: no explode and no shuffle before the top k
    tf = lambda w: F.size(F.filter("_w", lambda x: x == w)).cast("double")
    score = sum((F.lit(wanted[w] * v) * tf(w) * (K1 + 1) / (tf(w) + norm) for w, v in idf.items()), F.lit(0.0))
    # a plain substring test comes first: it needs no tokens, and no row with a term fails it
    near = reduce(lambda p, q: p | q, [F.col(text).contains(w) for w in idf])
    scored = t.where(near).select(id_col, F.round(score, 9).alias("score"))
    if k is None or min(idf.values()) <= 0:
        scored = scored.where("score != 0")
    return scored if k is None else scored.orderBy(F.col("score").desc(), id_col).limit(k).where("score != 0")


def index_tables(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, terms, stats): postings(id, term, tf, dl) for scans of single terms, terms(term, df), and one row (n, mean_dl, mean_idf)."""
    p = postings(docs, id_col, text)
    n = docs.where(F.col(text).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(words(F.col(text)))).alias("mean_dl"))
    terms = p.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    one = n.withColumn("_k", F.lit(1))
    # numbers of documents with a term are few: the idf is taken once for each of them
    by_df = terms.groupBy("df").agg(F.count(F.lit(1)).alias("k")).withColumn("_k", F.lit(1)).join(one, "_k")
    idf = (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)) * F.col("k")
    mean = by_df.agg((F.sum(idf) / F.sum("k")).alias("mean_idf"))
    return p, terms, one.join(mean.withColumn("_k", F.lit(1)), "_k", "left").drop("_k")


def write_index(docs: DataFrame, id_col: str, text: str, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index as tables; postings are sorted by term within their files, so that a query skips what it does not need."""
    spark, out = docs.sparkSession, []
    for name, t in zip(("postings", "terms", "stats"), index_tables(docs, id_col, text)):
        t = t.repartition("term").sortWithinPartitions("term", id_col) if name == "postings" else t
        t.write.mode("overwrite").parquet(f"{path}/{name}")
        out.append(spark.read.parquet(f"{path}/{name}"))
    return tuple(out)


def bm25_indexed(index: tuple[DataFrame, DataFrame, DataFrame], id_col: str, query: str | list[str], k: int = TOP_K) -> DataFrame:
    """(id, score) as bm25 gives them, from the tables of write_index: reads the postings of the query's terms and no text."""
    post, terms, stats = index
    wanted = Counter(query.split() if isinstance(query, str) else query)
    s = stats.first()
    idf = {r["term"]: math.log(s["n"] - r["df"] + 0.5) - math.log(r["df"] + 0.5) for r in terms.where(F.col("term").isin(list(wanted))).collect()}
    if not idf:
        return post.limit(0).select(id_col, F.lit(0.0).alias("score"))
    weight = F.create_map(*[x for w, v in idf.items() for x in (F.lit(w), F.lit(wanted[w] * (v if v >= 0 else EPSILON * s["mean_idf"])))])
    tf = F.col("tf").cast("double")
    part = weight[F.col("term")] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(float(s["mean_dl"]))))
    g = post.where(F.col("term").isin(list(idf))).groupBy(id_col).agg(F.round(F.sum(part), 9).alias("score"))
    return g.orderBy(F.col("score").desc(), id_col).limit(k).where("score != 0")


def bm25_many(docs: DataFrame, id_col: str, text: str, queries: list[list[str]], k: int = TOP_K) -> DataFrame:
    """(q, id, score, pos): the top k of every query, a list of terms, as bm25 gives them one by one; q is the query's number.

    One pass for the statistics of all terms and one that scores them all; only the k best of each query leave a partition, as numbers.
    Meant for the handful of queries that one question becomes.
    """
    wanted = [Counter(q) for q in queries]
    terms = list(dict.fromkeys(w for q in wanted for w in q))
    kind = docs.schema[id_col].dataType.simpleString()
    none = docs.sparkSession.createDataFrame([], f"q int, `{id_col}` {kind}, score double, pos int")
    if not terms:
        return none
    t = docs.where(F.col(text).isNotNull()).select(id_col, text, words(F.col(text)).alias("_w"))
    n, mean_dl, *found = t.agg(F.count(F.lit(1)), F.avg(F.size("_w")), *[F.count_if(F.array_contains("_w", w)) for w in terms]).first()
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in zip(terms, found) if d}
    if not idf:
        return none
    if min(idf.values()) < 0:
        df = t.select(F.explode(F.array_distinct("_w")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        (mean_idf,) = df.agg(F.avg(F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))).first()
        idf = {w: v if v >= 0 else EPSILON * mean_idf for w, v in idf.items()}
    norm = K1 * (1 - B + B * F.size("_w") / F.lit(float(mean_dl)))
    tf = lambda w: F.size(F.filter("_w", lambda x: x == w)).cast("double")
    near = reduce(lambda p, q: p | q, [F.col(text).contains(w) for w in idf])
    weights = {w: F.col(f"_t{i}") * (K1 + 1) / (F.col(f"_t{i}") + norm) * F.lit(v) for i, (w, v) in enumerate(idf.items())}
    counted = t.where(near).select(id_col, "_w", *[tf(w).alias(f"_t{i}") for i, w in enumerate(idf)])
    score = lambda q: F.round(sum((F.lit(float(c)) * weights[w] for w, c in q.items() if w in weights), F.lit(0.0)), 9)
    scored = counted.select(id_col, F.posexplode(F.array(*[score(q) for q in wanted])).alias("q", "score")).where("score != 0").select("q", id_col, "score")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for b in batches:
            b = b if kept is None else pd.concat([kept, b])
            kept = b.sort_values(["q", "score", id_col], ascending=[True, False, True]).groupby("q").head(k)
        if kept is not None:
            yield kept

    w = Window.partitionBy("q").orderBy(F.col("score").desc(), id_col)
    part = scored.mapInPandas(best, f"q int, `{id_col}` {kind}, score double")
    return part.withColumn("pos", F.row_number().over(w) - 1).where(F.col("pos") < k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays in doubles; null for a zero vector or different lengths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def dense_topk(vectors: DataFrame, id_col: str, vector: str, query: list[float], k: int = TOP_K, where: Column | None = None) -> DataFrame:
    """(id, score) of the k nearest vectors by cosine; a filter is applied before the ranking.  Ties go to the lower id."""
    q, v = F.array(*[F.lit(float(x)) for x in query]), F.col(vector)
    length = math.sqrt(sum(float(x) ** 2 for x in query))
    rows = vectors if where is None else vectors.where(where)
    both = F.aggregate(  # product with the query and square in one pass over the vector
        F.zip_with(v, q, lambda x, y: F.struct(x.cast("double").alias("x"), y.alias("y"))),
        F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("s")),
        lambda a, e: F.struct((a["p"] + e["x"] * e["y"]).alias("p"), (a["s"] + e["x"] * e["x"]).alias("s")),
    )
    r = rows.where(F.size(v) == len(query)).select(id_col, both.alias("b"))
    s = r.where("b.s > 0").select(id_col, F.round(F.col("b.p") / (F.sqrt("b.s") * F.lit(length)), 6).alias("score")).where(F.col("score").isNotNull())
    s = s if length > 0 else s.limit(0)
    return s.orderBy(F.col("score").desc(), id_col).limit(k)


def _packed(rows: DataFrame, id_col: str, vector: str, per_block: int, name: str) -> DataFrame:
    """One row (name) per block of about per_block rows: their ids and vectors.  Which block a row is in follows from its id."""
    n = max(1, -(-rows.count() // per_block))
    block = F.pmod(F.xxhash64(id_col), F.lit(n))
    return rows.groupBy(block.alias("_b")).agg(F.collect_list(F.struct(F.col(id_col).alias("id"), F.col(vector).alias("v"))).alias(name)).select(name)


def _matrices(packed: pa.Scalar) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, vectors and norms of a block by the vectors' length, in order of id; rows that no cosine is defined for are left out."""
    ids, vectors = packed.values.field("id").to_numpy(), packed.values.field("v")
    lengths, flat = np.diff(vectors.offsets.to_numpy()), vectors.values.to_numpy(zero_copy_only=False).astype("float64")
    starts, out = vectors.offsets.to_numpy()[:-1], {}
    for n in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == n)
        at = at[np.argsort(ids[at], kind="stable")]
        m = flat[starts[at][:, None] + np.arange(n)]
        norm = np.sqrt((m * m).sum(axis=1))
        ok = np.isfinite(norm) & (norm > 0)
        out[int(n)] = ids[at][ok], m[ok], norm[ok]
    return out


def dense_topk_all(queries: DataFrame, vectors: DataFrame, id_col: str, vector: str, k: int = TOP_K, where: Column | None = None) -> DataFrame:
    """(query, id, score, pos): for every row of `queries` the k nearest of `vectors` by cosine, as dense_topk gives them one by one.

    Both have the columns id_col (a whole number) and vector; a query that is among the vectors finds itself.  A filter is applied
    to the vectors before the ranking.  Null and zero vectors, and those with a null inside, find nothing and are not found.
    Every block of queries meets every block of vectors once, as one product of matrices of bounded size; what leaves a pair is
    the k best of each query there, and these are merged by query.
    """
    there = F.col(vector).isNotNull()
    a = _packed(queries.where(there), id_col, vector, QUERY_BLOCK, "q")
    b = _packed((vectors if where is None else vectors.where(where)).where(there), id_col, vector, VECTOR_BLOCK, "d")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, d in zip(batch.column("q"), batch.column("d")):
                right = _matrices(d)
                for n, (qid, qm, qn) in _matrices(q).items():
                    if n not in right or not len(qid) or not len(right[n][0]):
                        continue
                    did, dm, dn = right[n]
                    s = np.round(qm @ dm.T / (qn[:, None] * dn[None, :]), 6)
                    least = np.partition(s, -min(k, len(did)), axis=1)[:, -min(k, len(did))]
                    row, col = np.nonzero(s >= least[:, None])
                    order = np.lexsort((col, -s[row, col], row))  # columns are in order of id
                    row, col = row[order], col[order]
                    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                    row, col = row[keep], col[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(qid[row], pa.int64()), pa.array(did[col], pa.int64()), pa.array(s[row, col])], ["query", "id", "score"])

    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    part = a.crossJoin(b).mapInArrow(best, "query long, id long, score double")
    return part.withColumn("pos", F.row_number().over(w) - 1).where(F.col("pos") < k)


def fuse(semantic: DataFrame, keyword: DataFrame, content: str, pos: str = "pos") -> DataFrame:
    """(content, score, arrival) of two ranked lists, identity being the content itself.

    With n semantic and m keyword results, a semantic hit at i scores (n - i) * 0.7, the last of its repetitions counting; a
    keyword hit at i adds 2 * (m - i) * 0.3, except that the first occurrence of a content that only the keyword list
    has counts once.  Ties keep arrival order, the semantic list first.
    """
    whole = Window.partitionBy()
    rank = lambda df, w: df.select(F.col(content).alias("c"), F.col(pos).alias("p")).withColumn(
        "i", F.row_number().over(Window.orderBy("p")) - 1
    ).withColumn("v", (F.count(F.lit(1)).over(whole) - F.col("i")) * F.lit(w))
    s = rank(semantic, SEMANTIC_WEIGHT).groupBy("c").agg(F.min("v").alias("sv"), F.min("i").alias("si"))
    k = rank(keyword, KEYWORD_WEIGHT).groupBy("c").agg(F.sum("v").alias("kv"), F.max("v").alias("kfirst"), F.min("i").alias("ki"))
    j = s.join(k, s["c"].eqNullSafe(k["c"]), "full_outer")
    only = 2 * F.col("kv") - F.col("kfirst")
    score = F.when(F.col("sv").isNull(), only).otherwise(F.col("sv") + 2 * F.coalesce("kv", F.lit(0.0)))
    arrival = F.when(F.col("si").isNotNull(), F.col("si")).otherwise(1_000_000 + F.col("ki"))
    return j.select(F.coalesce(s["c"], k["c"]).alias(content), F.round(score, 6).alias("score"), arrival.cast("long").alias("arrival"))


def boost(hits: DataFrame, rules: list[tuple[Column, float]], score: str = "score") -> DataFrame:
    """Scores multiplied by the factor of every rule that holds."""
    f = F.lit(1.0)
    for cond, factor in rules:
        f = f * F.when(cond, F.lit(factor)).otherwise(F.lit(1.0))
    return hits.withColumn(score, F.col(score) * f)


def script_rules(original: Column, translation: Column) -> list[tuple[Column, float]]:
    """Texts in the original script up, translations down, unless a text is both."""
    return [(original & ~translation, 2.5), (translation & ~original, 0.6)]


def source_rules(primary: Column, commentary: Column) -> list[tuple[Column, float]]:
    return [(primary & ~commentary, 2.0), (commentary & ~primary, 0.5)]


TOPIC_FACTOR = 3.0


def topic_rules(question: str, topics: list[tuple[list[list[str]], Column]]) -> list[tuple[Column, float]]:
    """A rule for every topic the question is about: topics are (groups of words, condition on rows), and a question is about one if it
    has a word of every group."""
    low = question.lower()
    return [(rows, TOPIC_FACTOR) for groups, rows in topics if all(any(w in low for w in g) for g in groups)]


# Words that make a question comparative wherever they occur in it.
COMPARATIVE = ["both", "compare", "comparison", "versus", "vs", "between", "earlier", "later", "across", "layers", "evolve", "evolution", "over time", "diachronic"]


def detect_sources(questions: DataFrame, question: str, patterns: dict[str, list[str]]) -> DataFrame:
    """questions with `sources` (those named as whole words, in the order of `patterns`) and `strict`: exactly one, no comparison."""
    q = F.lower(F.col(question))
    named = [F.when(q.rlike(r"(?<![\p{L}\p{M}\p{N}_])(?:" + "|".join(r"\Q" + p + r"\E" for p in ps) + r")(?![\p{L}\p{M}\p{N}_])"), F.lit(s)) for s, ps in patterns.items()]
    compared = F.lit(False)
    for w in COMPARATIVE:
        compared = compared | q.contains(w)
    d = questions.withColumn("sources", F.array_compact(F.array(*named)))
    return d.withColumn("strict", (F.size("sources") == 1) & ~compared)


def source_match(sources: list[str], fields: list[str], title: str | None = None, always: Column | None = None) -> Column:
    """Whether a row belongs to one of the sources: its name occurs in a field, or in words in the title."""
    out = always if always is not None else F.lit(False)
    for s in sources:
        for f in fields:
            out = out | F.coalesce(F.lower(F.col(f)).contains(s), F.lit(False))
        if title:
            out = out | F.coalesce(F.lower(F.col(title)).contains(s.replace("_", " ")), F.lit(False))
    return out


def filter_source(hits: DataFrame, match: Column, strict: bool, pos: str = "pos") -> DataFrame:
    """Result list with matching rows alone (all rows if none matches), or with matching rows first; `pos` is renumbered."""
    h = hits.withColumn("_m", match)
    if strict:
        h = h.withColumn("_any", F.max("_m").over(Window.partitionBy())).where(F.col("_m") | ~F.col("_any")).withColumn("_m", F.lit(True)).drop("_any")
    return h.withColumn(pos, F.row_number().over(Window.orderBy((~F.col("_m")).cast("int"), pos)) - 1).drop("_m")


def union_variants(lists: DataFrame, variant: str, pos: str, content: str, prefix: int = 200) -> DataFrame:
    """First occurrence of every content over several result lists; contents with equal first characters count as one."""
    key = F.substring(F.col(content), 1, prefix)
    cols = [c for c in lists.columns if c not in (variant, pos)]
    first = lists.groupBy(key.alias("_key")).agg(F.min(F.struct(variant, pos, *cols)).alias("f"))  # combined before the shuffle
    return first.select(*[F.col(f"f.{c}") for c in lists.columns])


def backfill(ranked: DataFrame, more: DataFrame, content: str, pos: str = "pos", prefix: int = 200) -> DataFrame:
    """ranked, then those of `more` whose first characters it does not have yet, in their own order."""
    key = F.substring(F.col(content), 1, prefix)
    have = ranked.select(key.alias("_key")).distinct()
    new = more.withColumn("_key", key).join(have, "_key", "left_anti").drop("_key")
    both = ranked.withColumn("_part", F.lit(0)).unionByName(new.withColumn("_part", F.lit(1)))
    return both.withColumn(pos, F.row_number().over(Window.orderBy("_part", pos)) - 1).drop("_part")


def interleave(ranked: DataFrame, layer: str, pos: str = "pos", top: int = 4) -> DataFrame:
    """Layer-balanced order: the best `top` of every known layer in turn, then the rest as they were.

    With fewer than two known layers the order stays.  Runs on result lists; `pos` is renumbered.
    """
    r = ranked.withColumn("_r", F.row_number().over(Window.partitionBy(layer).orderBy(pos)))
    known = F.size(F.collect_set(layer).over(Window.partitionBy())) >= 2
    first = known & F.col(layer).isNotNull() & (F.col("_r") <= top)
    order = [(~first).cast("int"), F.when(first, F.col("_r")).otherwise(0), F.when(first, F.col(layer)), pos]
    flagged = r.withColumn("_o", F.struct(*[o.alias(f"o{i}") if not isinstance(o, str) else F.col(o).alias(f"o{i}") for i, o in enumerate(order)]))
    return flagged.withColumn(pos, F.row_number().over(Window.orderBy("_o")) - 1).drop("_r", "_o")


def tag_layers(ranked: DataFrame, text: str, title: str, name: str, layer: str, pos: str = "pos", first: int = 8) -> DataFrame:
    """The first results carry a line that names their source and layer."""
    line = F.concat(
        F.lit("[SOURCE: "), F.coalesce(title, F.lit("")), F.lit(" — chronology: "), F.coalesce(name, F.lit("unknown")),
        F.lit(", layer "), F.coalesce(F.col(layer).cast("string"), F.lit("?")), F.lit("]\n"), F.col(text),
    )
    return ranked.withColumn(text, F.when((F.col(pos) < first) & ~F.col(text).startswith("[SOURCE:"), line).otherwise(F.col(text)))
