"""The fact graph: keys, trust, batch upsert, inverses, adjacency, walks, statistics, extraction from model text.

An edge is identified by (subject_key, relation, object_key).  Facts carry `seq`, the order in which they were stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shabdagrid.functions.text import normalize_latin, strip_accents

# The relations a graph may hold.
RELATIONS = (
    "has_son has_daughter has_father has_mother has_brother has_sister has_spouse member_of_dynasty founded_dynasty patronymic epithet "
    "is_king_of is_purohita_of is_disciple_of is_guru_of fought allied_with performed_ritual received_boon same_as located_at "
    "flows_through associated_with_place originates_from disappears_at dwells_on has_attribute"
).split()
# Relations with at most one object per subject.
SINGLETONS = ["has_father", "has_mother", "is_king_of", "located_at", "disappears_at", "originates_from"]
# Relation and the relation it implies the other way round.
INVERSES = {
    "has_son": "has_father", "has_daughter": "has_father", "has_father": "has_son", "has_mother": "has_son", "has_brother": "has_brother",
    "has_sister": "has_sister", "has_spouse": "has_spouse", "same_as": "same_as", "is_disciple_of": "is_guru_of",
    "is_guru_of": "is_disciple_of", "fought": "fought", "allied_with": "allied_with",
}
TRUST = {"authoritative": 3, "itihasa": 2, "inferred": 1}
DISPLAY = {"authoritative": " ✓traditional", "itihasa": " ⚑legend(itihāsa)"}


def entity_key(c: Column) -> Column:
    """Lower case without accents; runs of other characters become one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def trust(c: Column) -> Column:
    """3 authoritative, 2 itihasa, 1 everything else, null included."""
    out = F.lit(1)
    for k, v in TRUST.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def edge_id(s: Column, r: Column, o: Column) -> Column:
    return F.sha1(F.concat_ws("|", s, r, o))


def valid_facts(facts: DataFrame) -> DataFrame:
    """Facts of a listed relation with subject and object, keyed; the rest can be counted as facts minus these."""
    f = facts.where(F.col("relation").isin(RELATIONS) & F.col("subject").isNotNull() & F.col("object").isNotNull())
    return f.withColumn("subject_key", entity_key(F.col("subject"))).withColumn("object_key", entity_key(F.col("object")))


def edges(facts: DataFrame, seq: str) -> DataFrame:
    """Batch upsert of facts(subject, relation, object, citation, provenance, seq).

    Equal triples fold into one edge: names as first stated, distinct citations in their order, highest trust.  Of a singleton
    relation's objects the one survives that was stated with the highest trust, of these the earliest; its citations are those
    stated for it.  The outcome does not depend on the order of rows, only on `seq`.
    """
    f = valid_facts(facts)
    first = F.min(F.struct(F.col(seq).alias("q"), "subject", "object"))
    cites = F.sort_array(F.collect_set(F.when(F.col("citation").isNotNull() & (F.trim("citation") != ""), F.struct(F.col(seq).alias("q"), "citation"))))
    g = f.groupBy("subject_key", "relation", "object_key").agg(
        first.alias("_f"), cites.alias("_c"), F.max(trust(F.col("provenance"))).alias("trust"),
        F.min(F.struct((-trust(F.col("provenance"))).alias("t"), F.col(seq).alias("q"))).alias("_best"),
    )
    single = F.col("relation").isin(SINGLETONS)
    cols = [c for c in g.columns if c not in ("subject_key", "relation")]
    one = g.where(single).groupBy("subject_key", "relation").agg(F.min_by(F.struct(*cols), "_best").alias("o")).select("subject_key", "relation", "o.*")
    kept = g.where(~single).unionByName(one)
    return kept.select(
        "subject_key", F.col("_f.subject").alias("subject"), "relation", "object_key", F.col("_f.object").alias("object"),
        F.array_distinct(F.transform("_c", lambda x: x["citation"])).alias("citations"), "trust", F.col("_f.q").alias("first_seq"),
    )


def with_inverses(e: DataFrame) -> DataFrame:
    """Edges and those they imply; a stated edge stands where both exist.  Inverses come from the final edges, so none is stale."""
    inv = F.create_map(*[x for k, v in INVERSES.items() for x in (F.lit(k), F.lit(v))])
    back = e.where(F.col("relation").isin(list(INVERSES))).select(
        F.col("object_key").alias("subject_key"), F.col("object").alias("subject"), inv[F.col("relation")].alias("relation"),
        F.col("subject_key").alias("object_key"), F.col("subject").alias("object"), "citations", "trust", "first_seq",
    )
    both = e.withColumn("stated", F.lit(1)).unionByName(back.withColumn("stated", F.lit(0)))
    best = F.max_by(F.struct("subject", "object", "citations", "trust", "first_seq", "stated"), F.struct("stated", "trust", -F.col("first_seq")))
    g = both.groupBy("subject_key", "relation", "object_key").agg(best.alias("b"))
    return g.select("subject_key", "relation", "object_key", "b.*")


def nodes(e: DataFrame) -> DataFrame:
    """(entity, display_name, out_degree) of subjects and objects."""
    s = e.select(F.col("subject_key").alias("entity"), F.col("subject").alias("name"), F.lit(1).alias("out"), "first_seq")
    o = e.select(F.col("object_key").alias("entity"), F.col("object").alias("name"), F.lit(0).alias("out"), "first_seq")
    return s.unionByName(o).groupBy("entity").agg(
        F.min(F.struct((-F.col("out")).alias("o"), "first_seq", "name"))["name"].alias("display_name"), F.sum("out").alias("out_degree")
    )


def members(e: DataFrame) -> DataFrame:
    """(dynasty, members) from membership edges."""
    m = e.where("relation = 'member_of_dynasty'")
    return m.groupBy(F.col("object_key").alias("dynasty")).agg(F.sort_array(F.collect_set("subject_key")).alias("members"))


def degree(e: DataFrame, top: int = 10) -> DataFrame:
    """The entities with most outgoing facts."""
    return e.groupBy("subject_key").agg(F.count(F.lit(1)).alias("facts")).orderBy(F.col("facts").desc(), "subject_key").limit(top)


def walk(e: DataFrame, start: DataFrame, hops: int = 2) -> DataFrame:
    """(subject_key, relation, object_key, hop): edges within `hops` outward steps of start(entity), at their first hop.

    The frontier is a distinct key set, so a cyclic graph ends with its hops.
    """
    frontier = start.select(F.col("entity").alias("subject_key")).distinct()
    found = None
    for hop in range(1, hops + 1):
        step = e.join(frontier, "subject_key", "left_semi").select("subject_key", "relation", "object_key", F.lit(hop).alias("hop"))
        found = step if found is None else found.unionByName(step)
        frontier = step.select(F.col("object_key").alias("subject_key")).distinct()
    return found.groupBy("subject_key", "relation", "object_key").agg(F.min("hop").alias("hop"))


def mentioned(questions: DataFrame, id_col: str, question: str, names: DataFrame) -> DataFrame:
    """(id, word, entity) of the words of questions whose plain form is a key of names(key); hyphens and accents do not matter."""
    w = questions.select(id_col, F.explode(F.array_distinct(F.regexp_extract_all(F.col(question), F.lit(r"[\p{L}&&[^\x{0900}-\x{097F}]][\p{L}\p{M}-]{2,}"), F.lit(0)))).alias("word"))
    w = w.withColumn("_k", normalize_latin(F.col("word")))
    return w.join(names.select(F.col("key").alias("_k")).distinct(), "_k", "left_semi").select(id_col, "word", entity_key(F.col("word")).alias("entity"))


def question_context(questions: DataFrame, id_col: str, question: str, names: DataFrame, e: DataFrame, hops: int = 2) -> DataFrame:
    """(id, subject_key, relation, object_key, hop, line): the facts within `hops` of the entities a question names.

    Walks all questions together: the frontier is a set of (question, entity) pairs."""
    frontier = mentioned(questions, id_col, question, names).select(id_col, F.col("entity").alias("subject_key")).distinct()
    lines, found = context_lines(e), None
    for hop in range(1, hops + 1):
        step = lines.join(frontier, "subject_key").select(id_col, "subject_key", "relation", "object_key", "line", F.lit(hop).alias("hop"))
        found = step if found is None else found.unionByName(step)
        frontier = step.select(id_col, F.col("object_key").alias("subject_key")).distinct()
    return found.groupBy(id_col, "subject_key", "relation", "object_key").agg(F.min("hop").alias("hop"), F.first("line").alias("line"))


def context_lines(e: DataFrame) -> DataFrame:
    """Edges as lines of an evidence block."""
    cites = F.array_join("citations", ", ")
    tag = F.when(F.col("trust") == 3, DISPLAY["authoritative"]).when(F.col("trust") == 2, DISPLAY["itihasa"]).otherwise("")
    line = F.concat(F.lit("  • "), "subject", F.lit(" —["), "relation", F.lit("]→ "), "object", F.when(cites != "", F.concat(F.lit("  ["), cites, F.lit("]"))).otherwise(""), tag)
    return e.withColumn("line", line)


def directed_graph(e: DataFrame) -> DataFrame:
    """One edge per ordered pair of entities, the last stated one of parallel edges."""
    return e.groupBy("subject_key", "object_key").agg(F.max_by("relation", F.struct("first_seq", "relation")).alias("relation"))


def facts_from_model_text(answers: DataFrame, text: str) -> DataFrame:
    """Facts in a model's JSON array, fences stripped; those without the four mandatory fields or with another relation are dropped."""
    body = F.regexp_extract(F.regexp_replace(F.col(text), "(?m)^```[a-z]*\\s*$", ""), r"(?s)\[.*\]", 0)
    kind = "array<struct<subject:string,relation:string,object:string,citation:string,confidence:string,note:string>>"
    f = answers.select(F.explode(F.from_json(F.nullif(body, F.lit("")), kind)).alias("f")).select("f.*")
    return f.where("subject is not null and object is not null and citation is not null").where(F.col("relation").isin(RELATIONS)).withColumn("confidence", F.coalesce("confidence", F.lit("medium")))


def new_edges(candidates: DataFrame, e: DataFrame) -> DataFrame:
    """Candidate facts whose edge the graph does not have."""
    return valid_facts(candidates).join(e, ["subject_key", "relation", "object_key"], "left_anti")


def triples(entities: DataFrame) -> DataFrame:
    """Flatten entities(key, display_name, relations[]) into triples, provenance kept."""
    r = entities.select(F.col("key").alias("subject_key"), F.col("display_name").alias("subject"), F.explode("relations").alias("r"))
    return r.select("subject_key", "subject", "r.*").withColumn("object_key", entity_key(F.col("object")))


def override_merge(bulk: DataFrame, curated: DataFrame, key: str) -> DataFrame:
    """Per-key union in which every non-null curated value replaces the bulk value; columns of either side are kept."""
    names = [c for c in dict.fromkeys([*bulk.columns, *curated.columns]) if c != key]
    b, c = bulk.alias("b"), curated.alias("c")
    pick = lambda n: F.coalesce(*[F.col(f"{s}.{n}") for s, d in (("c", curated), ("b", bulk)) if n in d.columns]).alias(n)
    return b.join(c, F.col(f"b.{key}") == F.col(f"c.{key}"), "full_outer").select(F.coalesce(f"c.{key}", f"b.{key}").alias(key), *[pick(n) for n in names])


def hymn_block(meta: DataFrame) -> DataFrame:
    """Hymn metadata as lines of an evidence block; absent fields give no line."""
    rows = [("Ṛṣi (composer)", "rishi"), ("Devatā", "devata"), ("Meter", "meter"), ("Patron", "patron"), ("Theme", "theme"), ("Legend", "legend")]
    lines = [F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.concat(F.lit(f"  • {n}: "), F.col(c))) for n, c in rows if c in meta.columns]
    return meta.withColumn("block", F.concat_ws("\n", *lines))
