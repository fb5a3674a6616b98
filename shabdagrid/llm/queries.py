"""Queries of the nine problems, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shabdagrid.llm import components, encoding, format_copies, fusion, name_variants, packing, splitting, stuffing, visual_form
from shabdagrid.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows of chunk and kg_seed whose texts look the same as that of a row with a lower id."""
    chunk = visual_form.same_look(table(spark, d, "chunk"), "chunk_id", "page_content")
    facts = visual_form.same_look(table(spark, d, "kg_seed"), "fact_id", "subject")
    named = lambda df, t: df.select(F.lit(t).alias("tbl"), "id_a", "id_b")
    return named(chunk, "chunk").unionByName(named(facts, "kg_seed"))


def p1_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every fact's subject in the consistent form, with the case-folded key beside it."""
    t = table(spark, d, "kg_seed").select("fact_id", "subject")
    t = visual_form.with_consistent_form(t, "subject", "form")
    return visual_form.with_consistent_form(t, "subject", "folded", fold_case=True)


def _records(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "kg_seed").select(F.lit("kg_seed").alias("tbl"), F.col("fact_id").alias("id"), *format_copies.FIELDS)
    raw = format_copies.parse_objects(table(spark, d, "kg_raw_line"), "line_id", "line")
    return facts.unionByName(raw.withColumn("tbl", F.lit("kg_raw_line")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Copies hidden by formatting, of facts and of landed JSON objects."""
    return format_copies.copies(_records(spark, d), "id").select("tbl", "keep_id", "copy_id")


def p2_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """One row per record with the number of its copies."""
    return format_copies.collapse(_records(spark, d), "id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Names that same_as facts link to a smaller one."""
    same = table(spark, d, "kg_seed").where("relation = 'same_as'")
    return components.connected_components(same, "subject", "object").where("name != group_name").select("group_name", "name")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that the splitter had to divide."""
    return splitting.split_items(table(spark, d, "chunk").select("chunk_id", "page_content"), "page_content").where("piece_no = 1").select("chunk_id")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Numbered pieces of the oversized chunks with the chunk's metadata."""
    t = table(spark, d, "chunk").where(F.length("page_content") > splitting.SIZE)
    return splitting.split_items(t, "page_content").select("chunk_id", "piece_no", "n_pieces", "piece_start", "piece", "metadata")


def p4_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Every oversized chunk put together again from its pieces, with the length of the longest and the number of wrong overlaps."""
    p = p4_pieces(spark, d)
    new = F.expr(f"substring(piece, if(piece_no = 0, 1, {splitting.OVERLAP + 1}))")
    g = p.groupBy("chunk_id").agg(
        F.array_sort(F.collect_list(F.struct("piece_no", "piece_start", "piece", new.alias("new")))).alias("p"), F.max(F.length("piece")).alias("longest")
    )  # the pieces of one chunk
    shared = F.transform(F.slice("p", 2, 1 << 20), lambda x, i: F.right(F.get("p", i)["piece"], F.lit(splitting.OVERLAP)) != F.left(x["piece"], F.lit(splitting.OVERLAP)))
    return g.select(
        "chunk_id", F.array_join(F.transform("p", lambda x: x["new"]), "").alias("page_content"), (F.col("longest") > splitting.SIZE).alias("too_long"),
        F.size(F.filter(shared, lambda x: x)).alias("wrong_overlaps"),
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The fact from which the survivor of every duplicate group takes each field."""
    return fusion.survivors(table(spark, d, "kg_dup_member"), table(spark, d, "kg_seed")).select("group_id", "field_name", "fact_id")


def p5_survivors(spark: SparkSession, d: str) -> DataFrame:
    """One surviving record per duplicate group."""
    return fusion.survivor_records(table(spark, d, "kg_dup_member"), table(spark, d, "kg_seed"))


# Relations whose object is a person.
PERSON_RELATIONS = (
    "has_father has_mother has_son has_daughter has_brother has_sister has_spouse is_disciple_of is_guru_of is_purohita_of fought allied_with"
).split()


def p6_names(spark: SparkSession, d: str) -> DataFrame:
    """The person of every typed name that has a family name."""
    typed = table(spark, d, "kg_seed").where("origin = 'typed'")
    names = typed.select(F.col("subject").alias("name")).unionByName(
        typed.where(F.col("relation").isin(PERSON_RELATIONS)).select(F.col("object").alias("name"))
    )
    return name_variants.link_names(names, table(spark, d, "proper_noun"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every two different spellings of one person."""
    return name_variants.spelling_pairs(p6_names(spark, d))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k."""
    return encoding.encode_texts(table(spark, d, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of 2,048 tokens of every document, or of every piece of one that alone exceeds it."""
    counted = encoding.count_tokens(table(spark, d, "documents"), "doc_id", "text")
    return packing.pack(counted, "doc_id", "n_tokens")


def p8_totals(spark: SparkSession, d: str) -> DataFrame:
    """The containers of p8_containers counted over: texts placed, containers too full, texts divided without need, room that a whole container makes up."""
    c = p8_containers(spark, d)
    fill = c.groupBy("container").agg(F.sum("size").alias("used"))
    per = fill.agg(F.count_if(F.col("used") > packing.CAPACITY).alias("overfull"), F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"))
    texts = c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("size").alias("n"))
    docs = texts.agg(F.count(F.lit(1)).alias("texts"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= packing.CAPACITY)).alias("divided_without_need"))
    per = per.select("overfull", (F.col("containers") - F.ceil(F.col("tokens") / packing.CAPACITY)).alias("spare_containers"))
    both = docs.unionByName(per, allowMissingColumns=True)  # one row each
    return both.agg(*[F.max(c).alias(c) for c in ("texts", "overfull", "divided_without_need", "spare_containers")])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are keywords, links, tags or items for the most part."""
    return p9_pages(spark, d).where("stuffed").select("doc_id")


def p9_pages(spark: SparkSession, d: str) -> DataFrame:
    """Measures and judgement of every document of some length."""
    return stuffing.judge_pages(table(spark, d, "documents"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_forms, p2_found, p2_collapsed, p3_found, p4_found, p4_pieces, p4_rebuilt, p5_found, p5_survivors, p6_found, p6_names, p7_ids, p8_containers, p8_totals, p9_found, p9_pages)
}
_q = lambda t: "'" + t.replace("'", "''") + "'"
# The SQL states its own values, so that a slip in the operators' tables shows.
_LOOK_FROM = "ΑАΒВСϹΕЕΗНΙІӀЈͿΚКΜМΝΟОΡРЅΤТΧХΥҮΖасϲԁеɡһіјϳοорԛѕνѵԝху"
_LOOK_TO = "AABBCCEEHHIIIJJKKMMNOOPPSTTXXYYZaccdeghijjoopqsvvwxy"
_WIDE_FROM = "".join(chr(cp) for cp in range(0xFF01, 0xFF5F))
_WIDE_TO = "".join(chr(cp) for cp in range(0x21, 0x7F))
_ignored = (
    r"\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}"
    r"\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF0}-\x{FFF8}\x{1BCA0}-\x{1BCA3}\x{1D173}-\x{1D17A}\x{E0000}-\x{E0FFF}"
)
_spaces = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _form_sql(text: str) -> str:
    """The consistent form for the kinds of characters that occur in the test tables, look-alikes always as Latin letters."""
    t = f"replace(regexp_replace({text}, '[{_ignored}]', '', 'g'), 'ﬁ', 'fi')"
    t = f"translate(nfc_normalize({t}), {_q(_LOOK_FROM + _WIDE_FROM + '‐‑')}, {_q(_LOOK_TO + _WIDE_TO + '--')})"
    t = f"regexp_replace(replace({t}, '।।', '॥'), '([\\x{{904}}-\\x{{963}}\\x{{971}}-\\x{{97F}}]):', '\\1ः', 'g')"
    for drawn, letter in (("अा", "आ"), ("उु", "ऊ"), ("एे", "ऐ"), ("अो", "ओ"), ("आे", "ओ"), ("अौ", "औ"), ("आै", "औ")):
        t = f"replace({t}, '{drawn}', '{letter}')"
    return f"trim(regexp_replace(nfc_normalize({t}), '{_spaces}', ' ', 'g'), ' ')"


def _words_sql(field: str) -> str:
    return f"coalesce(trim(regexp_replace(lower(nfc_normalize({field})), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g'), ' '), chr(2))"


def _json_sql(field: str) -> str:
    return f"(SELECT max(json_extract_string(j, '$.\"' || k || '\"')) FROM (SELECT unnest(json_keys(j)) AS k) WHERE lower(trim(k)) = '{field}') AS {field}"


_SURVIVORS = """
WITH m AS (
  SELECT DISTINCT d.group_id, k.fact_id, k.added_at, k.object, k.citation, k.note, k.provenance,
    CASE regexp_replace(lower(k.provenance), '[^a-z]', '', 'g') WHEN 'authoritative' THEN 3 WHEN 'itihasa' THEN 2 WHEN 'inferred' THEN 1 ELSE 0 END AS trust
  FROM kg_dup_member d JOIN kg_seed k USING (fact_id)
), v AS (
  SELECT group_id, fact_id, added_at, trust, 'object' AS field_name, object AS value FROM m
  UNION ALL SELECT group_id, fact_id, added_at, trust, 'citation', citation FROM m
  UNION ALL SELECT group_id, fact_id, added_at, trust, 'note', note FROM m
  UNION ALL SELECT group_id, fact_id, added_at, trust, 'provenance', provenance FROM m
), w AS (
  SELECT *, row_number() OVER (PARTITION BY group_id, field_name ORDER BY trust DESC, added_at DESC NULLS LAST, fact_id) AS r FROM v
  WHERE value IS NOT NULL AND lower(trim(value)) NOT IN ('', '-', '—', '?', '...', 'n/a', 'unknown', 'unknown.', 'none', 'null', 'tbd', 'not given')
)
"""


def _copies_sql() -> str:
    words = ", ".join(_words_sql(f) for f in format_copies.FIELDS)
    return f"""
WITH o AS (SELECT line_id, regexp_extract(line, '(?s)\\{{.*\\}}') AS j FROM kg_raw_line),
r AS (SELECT 'kg_seed' AS tbl, fact_id AS id, subject, relation, object, citation FROM kg_seed
  UNION ALL SELECT 'kg_raw_line', line_id, {', '.join(_json_sql(f) for f in format_copies.FIELDS)} FROM o WHERE json_valid(j)),
k AS (SELECT *, min(id) OVER (PARTITION BY tbl, {words}) AS keep_id, count(*) OVER (PARTITION BY tbl, {words}) AS copies FROM r)"""


ORACLE: dict[str, str] = {
    "p1_found": f"""
WITH t AS (SELECT 'chunk' AS tbl, chunk_id AS id, page_content AS x FROM chunk UNION ALL SELECT 'kg_seed', fact_id, subject FROM kg_seed),
f AS (SELECT *, {_form_sql('x')} AS form FROM t WHERE x IS NOT NULL),
h AS (SELECT tbl, form, min(id) AS id_a, min_by(x, id) AS xa FROM f WHERE form <> '' GROUP BY 1, 2)
SELECT tbl, id_a, id AS id_b FROM f JOIN h USING (tbl, form) WHERE x <> xa""",
    "p2_found": f"{_copies_sql()} SELECT tbl, keep_id, id AS copy_id FROM k WHERE id <> keep_id",
    "p2_collapsed": f"{_copies_sql()} SELECT tbl, id, subject, relation, object, citation, copies FROM k WHERE id = keep_id",
    "p3_found": """
WITH RECURSIVE e AS (
  SELECT DISTINCT subject AS a, object AS b FROM kg_seed WHERE relation = 'same_as' AND subject IS NOT NULL AND object IS NOT NULL AND subject <> object
), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS v, a AS w FROM u UNION SELECT r.v, u.b FROM r JOIN u ON r.w = u.a)
SELECT min(w) AS group_name, v AS name FROM r GROUP BY v HAVING min(w) <> v""",
    "p5_found": f"{_SURVIVORS} SELECT group_id, field_name, fact_id FROM w WHERE r = 1",
    "p5_survivors": f"{_SURVIVORS} SELECT group_id, {', '.join(f"max(CASE WHEN field_name = '{f}' THEN value END) AS {f}" for f in fusion.FIELDS)} FROM w WHERE r = 1 GROUP BY group_id",
    "p8_totals": "SELECT count(*) AS texts, 0 AS overfull, 0 AS divided_without_need, 0 AS spare_containers FROM documents",
    "p4_rebuilt": "SELECT chunk_id, page_content, false AS too_long, 0 AS wrong_overlaps FROM chunk WHERE length(page_content) > 512",
    "p4_found": "SELECT chunk_id FROM chunk WHERE length(page_content) > 512",
}
