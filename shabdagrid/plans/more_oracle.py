"""DuckDB SQL of the further queries, and of those whose stages have grown."""

from __future__ import annotations

from shabdagrid.plans.oracle import (
    CHUNK_LINES, DEVANAGARI, EDGES, KEY, ORACLE, SECTIONS, STEM, VARIANT_INDEX, VARIANTS, VERSE_ID, WORDS, WS, _any, bm25_sql, dense_sql, doc, fact, fuse_sql, lst, q, ranked_sql,
)

MANY = ["river hymn", "hymn singer altar", "refrain", "nosuchword", "ladle ladle"]
PLAN_CONSTRUCTION = ["how do i say", "translate", "in sanskrit", "sanskrit for", "how to say", "say in sanskrit", "sanskrit word for", "construct", "write in sanskrit"]
PLAN_GRAMMAR = ["explain", "what is the rule", "how does", "declension", "conjugation"]
PLANNED = f"CASE WHEN {_any('text', PLAN_CONSTRUCTION)} THEN 'construction' WHEN {_any('text', PLAN_GRAMMAR)} THEN 'grammar' ELSE 'factual' END"
_bare = r"regexp_replace(text, '[\x{0900}-\x{0903}\x{093C}-\x{094D}\x{0951}-\x{0954}]', '', 'g')"
_tokens = rf"list_filter(regexp_split_to_array({_bare}, '[\s\x{{0B}}।॥\-,.;:!?]+'), lambda x: x <> '')"
_at = [r"translate\s+([^?]+?)(?:\s+in|\s+to|$)", r"say\s+([^?]+?)(?:\s+in|$)", r"how do i say\s+([^?]+?)(?:\s+in|$)", r"sanskrit for\s+([^?]+?)(?:\?|$)"]
_quoted = "lower(regexp_extract(text, '[''\"]([^''\"]+)[''\"]', 1))"
_said = ", ".join(f"nullif(trim(regexp_extract(lower(text), {q(p)}, 1), ' '), '')" for p in _at)
_words = f"list_filter(regexp_split_to_array(regexp_replace(coalesce(nullif({_quoted}, ''), {_said}, lower(text)), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s\\x{{0B}}]', ' ', 'g'), '[\\s\\x{{0B}}]+'), lambda w: length(w) > 2 AND NOT list_contains([{lst('do i say in sanskrit to the a an me can please vedic translate'.split())}], w))"
_dictionary_key = lambda c: rf"trim(lower(regexp_replace(regexp_replace({c}, '[/\\-]', '', 'g'), '[।॥.,;:!?]', '', 'g')), ' ')"
_key_terms = lambda c: (
    rf"list_filter(regexp_extract_all(regexp_replace(regexp_replace({c}, '<[^>]+>', '', 'g'), '\([^)]+\)', '', 'g'), '[\p{{L}}\p{{M}}\p{{N}}_]+'), "
    "lambda x: regexp_matches(x, '^[a-zA-Z]{5,}$') AND NOT list_contains(['which', 'there', 'their', 'about', 'other', 'being', 'having', 'called', 'often'], lower(x)))[:5]"
)
CONCEPTS = """(SELECT canonical AS primary_key, coalesce(list_sort(min_by({'v': variants}, category).v), []) AS variants, min_by({'c': context}, category).c AS context,
  coalesce(min_by({'s': sources}, category).s, []) AS refs FROM proper_noun WHERE canonical IS NOT NULL GROUP BY 1)"""
INDEX = f"(SELECT {_dictionary_key('v')} AS normalized, min(primary_key) AS primary_key FROM (SELECT primary_key, unnest(list_distinct([primary_key] || variants)) AS v FROM {CONCEPTS}) GROUP BY 1 HAVING normalized <> '')"
FOUND = f"(SELECT w.fact_id, w.pos, w.word, c.* FROM {WORDS} w JOIN {INDEX} i ON {_dictionary_key('w.word')} = i.normalized JOIN {CONCEPTS} c USING (primary_key) WHERE length(w.word) >= 3)"
EVERY = "(SELECT DISTINCT unnest(regexp_split_to_array(note, '[\\s\\x{0B}]+')) AS w FROM kg_seed WHERE note IS NOT NULL)"


def chunk_bm25_sql(query: str, k: int = 15) -> str:
    """A subquery (text, pos) of the best chunks, ties by id."""
    inner = bm25_sql(query, k).replace("doc_id", "chunk_id").replace("regexp_split_to_array(text,", "regexp_split_to_array(page_content,").replace("FROM documents WHERE text IS", "FROM chunk WHERE page_content IS")
    return f"(SELECT page_content AS text, chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) - 1 AS pos FROM {inner} JOIN chunk USING (chunk_id))"


_expand = f"""v AS (SELECT pos, i, ids[i] AS vid FROM (SELECT pos, ids, unnest(range(1, len(ids) + 1)) AS i FROM (SELECT pos, regexp_extract_all(text, '{VERSE_ID}', 1) AS ids FROM r WHERE pos < 3))),
s AS (SELECT pos, {SECTIONS('vid')} AS section, min(i) AS i FROM v GROUP BY ALL),
l AS (SELECT {SECTIONS('vid')} AS section, regexp_extract(vid, '(\\d+)$', 1)::INT AS no, max_by(line, (chunk_id, n)) AS line FROM {CHUNK_LINES} WHERE vid <> '' GROUP BY ALL),
t AS (SELECT section, string_agg(line, chr(10) ORDER BY no) AS t FROM l GROUP BY section),
x AS (SELECT pos, left(string_agg('## ' || section || chr(10) || t, chr(10) || chr(10) ORDER BY i), 6000) AS whole FROM s JOIN t USING (section) GROUP BY pos)"""
_topic_semantic, _topic_keyword = "offering to the river and the altar", "offering to  river and  altar"

def all_vectors_sql(where: str = "true") -> str:
    """The fifteen nearest of every twentieth vector."""
    return f"""SELECT q.vec_id AS query, v.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, v.vec_id) - 1 AS pos FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND {where} QUALIFY pos < 15"""


ORACLE |= {
    "dense_topk_all": all_vectors_sql(),
    "dense_topk_all_filtered": all_vectors_sql("v.label = 1"),
    "question_modes": doc(
        r"CASE WHEN regexp_matches(text, '(?i)(earlier|early|later|late|older|newer)[^.?]*\b(vedic|veda|period|layer|mandala|time)|evolv|over time|diachronic|through time|chronolog') THEN 'diachronic' "
        r"WHEN regexp_matches(text, '(?i)\b(which|what|where|list|all|every|how\s+many|find|show|give|tell|discuss|talk|about|search|name|enumerate|any)\b') "
        r"AND regexp_matches(text, '(?i)\b(verse|verses|hymn|hymns|mention|mentions|mentioned|contain|contains|occur|occurs|appear|appears|talk|talks|reference|references|passage|passages)\b') THEN 'concordance' ELSE 'plain' END"
    ),
    "hybrid_search": f"""
WITH k AS (SELECT * FROM {ranked_sql('river hymn singer altar', 15)}),
s AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS pos FROM {dense_sql()}),
ids AS (SELECT doc_id FROM k UNION SELECT doc_id FROM s),
f AS (SELECT * FROM {fuse_sql("(SELECT text, pos FROM s JOIN documents USING (doc_id) WHERE text IS NOT NULL)", "(SELECT text, pos FROM k JOIN documents USING (doc_id) WHERE text IS NOT NULL)")}),
b AS (SELECT text, arrival, score * CASE WHEN (length(left(text, 1000)) - length(regexp_replace(left(text, 1000), '{DEVANAGARI}', '', 'g'))) / greatest(1, length(left(text, 1000))) > 0.05 THEN 2.5 ELSE 1 END AS score FROM f),
r AS (SELECT (SELECT min(doc_id) FROM documents x JOIN ids USING (doc_id) WHERE x.text = b.text) AS doc_id, round(score, 6)::DOUBLE AS score, row_number() OVER (ORDER BY round(score, 6) DESC, arrival) - 1 AS pos FROM b)
SELECT doc_id, score, pos FROM r WHERE pos < 17""",
    "chain_topic": f"""
WITH k AS (SELECT * FROM {chunk_bm25_sql(_topic_keyword)}), m AS (SELECT * FROM {chunk_bm25_sql(_topic_semantic)}),
ids AS (SELECT chunk_id FROM k UNION SELECT chunk_id FROM m),
u AS (SELECT text, min(pos) AS pos FROM m GROUP BY left(text, 200), text QUALIFY row_number() OVER (PARTITION BY left(text, 200) ORDER BY min(pos)) = 1),
f AS (SELECT * FROM {fuse_sql('(SELECT text, pos FROM u)', '(SELECT text, pos FROM k)')}),
b AS (SELECT f.text, arrival, c.chunk_id, c.metadata.veda AS veda, score
  * CASE WHEN (length(left(f.text, 1000)) - length(regexp_replace(left(f.text, 1000), '{DEVANAGARI}', '', 'g'))) / greatest(1, length(left(f.text, 1000))) > 0.05 THEN 2.5 ELSE 1 END
  * CASE WHEN contains(lower(c.metadata.title), 'kapila') THEN 3 ELSE 1 END AS score
  FROM f JOIN chunk c ON c.chunk_id = (SELECT min(chunk_id) FROM chunk y JOIN ids USING (chunk_id) WHERE y.page_content = f.text)),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, arrival) - 1 AS pos FROM b), {_expand}
SELECT chunk_id, round(score, 6)::DOUBLE AS score, pos, veda, md5(CASE WHEN coalesce(length(whole) > length(text), false) THEN whole ELSE text END) AS content FROM r LEFT JOIN x USING (pos) WHERE pos < 17""",
    "bm25_batch": " UNION ALL ".join(f"SELECT {i} AS q, doc_id, score, pos FROM {ranked_sql(t, 15)}" for i, t in enumerate(MANY)),
    "dictionary_expansion": f"""
WITH h AS (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY pos) AS r FROM {FOUND}),
e AS (SELECT fact_id, flatten(list(coalesce({_key_terms('context')}, [])[:2] || variants[:2] ORDER BY pos)) AS t FROM h WHERE r <= 3 GROUP BY 1)
SELECT k.fact_id, concat_ws(' ', subject, nullif(array_to_string(list_filter(coalesce(t, []), lambda x, i: list_position(t, x) = i)[:5], ' '), '')) AS expanded
FROM kg_seed k LEFT JOIN e USING (fact_id) WHERE subject IS NOT NULL""",
    "dictionary_references": f"SELECT DISTINCT fact_id, word, array_to_string(refs, '|') AS refs FROM {FOUND} WHERE len(refs) > 0",
    "dictionary_variants": f"""
WITH t AS (SELECT DISTINCT word AS term FROM {WORDS} WHERE pos = 0)
SELECT term, list_sort(list_distinct(list_filter([term] || coalesce(variants || [primary_key], []), lambda x: x <> ''))) AS variants
FROM t LEFT JOIN {INDEX} i ON {_dictionary_key('term')} = normalized LEFT JOIN {CONCEPTS} c USING (primary_key)""",
    "dictionary_stats": f"SELECT (SELECT count(*) FROM {CONCEPTS}) AS total_concepts, (SELECT count(*) FROM {INDEX}) AS total_lookup_keys",
    "source_forms": f"""
WITH there AS (SELECT DISTINCT canonical FROM proper_noun WHERE list_contains(sources, 'v01')), f AS (SELECT canonical, list_sort(list_distinct(list(f))) AS forms FROM {VARIANTS} GROUP BY 1)
SELECT canonical, CASE WHEN canonical IN (SELECT canonical FROM there) THEN forms ELSE [canonical] END AS forms FROM f""",
    "known_names": f"SELECT DISTINCT word, lower(trim(word)) IN (SELECT lower(trim(variant)) FROM {VARIANT_INDEX} WHERE variant IS NOT NULL) AS known FROM {WORDS}",
    "noun_entry": f"""SELECT canonical, category, role, context, sources FROM proper_noun WHERE canonical IN (SELECT canonical FROM {VARIANT_INDEX} WHERE lower(variant) = 'dikātsu')
QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY list_position(['given_name', 'place', 'tribe', 'deity'], category)) = 1""",
    "group_members": f"""
WITH e AS (SELECT * FROM {EDGES}), g AS (SELECT object_key AS grp, subject_key AS member FROM e WHERE relation = 'member_of_dynasty'),
t AS (SELECT first_seq AS id, subject_key AS term FROM e WHERE first_seq % 20 = 0), n AS (SELECT * FROM t UNION SELECT id, grp FROM t JOIN g ON term = member)
SELECT * FROM n UNION SELECT id, member FROM n JOIN g ON term = grp""",
    "word_translations": f"""
WITH w AS (SELECT DISTINCT lower(w) AS word FROM {EVERY}), a AS (SELECT * FROM (VALUES ('river', 'nadī', 'noun', 0.95), ('river', 'sindhu', 'noun', 0.85), ('river', 'sarit', 'noun', 0.85), ('once', 'sakṛt', 'adverb', 0.95), ('read', 'paṭh', 'noun', 0.85)) v(word, term, kind, confidence)
UNION SELECT lower(canonical), canonical, 'proper_noun', 0.9 FROM proper_noun WHERE canonical IS NOT NULL)
SELECT word, term, kind, confidence::DOUBLE AS confidence FROM w JOIN a USING (word)""",
    "planned_types": doc(PLANNED),
    "planned_tools": doc(f"CASE {PLANNED} WHEN 'construction' THEN 'dictionary' WHEN 'grammar' THEN 'grammar' ELSE 'corpus' END"),
    "planned_words": doc(f"CASE WHEN {_any('text', PLAN_CONSTRUCTION)} THEN array_to_string({_words}, '|') ELSE '' END"),
    "lexicon_terms": doc("concat_ws('|', CASE WHEN contains(lower(text), 'river') THEN 'nadī|sindhu|sarit|dhunī' END, CASE WHEN contains(lower(text), 'fire') THEN 'agni' END, CASE WHEN contains(lower(text), 'king') THEN 'rājan|rāj' END)"),
    "embedding_texts": doc(f"array_to_string({_tokens}, ' ')"),
    "stemmed_queries": doc(f"array_to_string(list_transform({_tokens}, lambda x: {STEM}), ' ')"),
    "metadata_citations": "SELECT chunk_id, CASE WHEN metadata.mandala IS NOT NULL THEN 'RV ' || metadata.mandala || '.' || pos WHEN nullif(metadata.pb_section, '') IS NOT NULL THEN 'YV ?.' || metadata.pb_section END AS citation FROM chunk",
    "citation_passages": f"SELECT string_agg('Passage ' || (pos + 1) || ':' || chr(10) || left(text, 500), chr(10) || chr(10) ORDER BY pos) AS block FROM {ranked_sql('river hymn', 15)} JOIN documents USING (doc_id)",
    "citation_rows": f"""WITH h AS (SELECT pos, source, CASE WHEN l.value LIKE 'Passage %' THEN 'Passage ' || (pos + 1) ELSE l.value END AS c FROM {ranked_sql('river hymn', 15)} JOIN documents USING (doc_id) JOIN ({ORACLE['citation_labels']}) l USING (doc_id))
SELECT c AS citation, coalesce(source, 'Unknown') AS source, pos AS chunk_index, regexp_replace(translate(lower(c), ' .', '--'), '[^a-z0-9-]', '', 'g') AS url_fragment FROM h""",
    "reference_kinds": """SELECT * FROM (VALUES
(1, 'Ramayana Book 2, Canto 14, Verse 7', 'Book II.', 'II', 'XIV', ''), (2, 'RV 5.61', '[05-061] HYMN LXI. Maruts.', '', '', ''), (3, 'RV 7.18.9', NULL, '', '', ''), (4, 'YV 3.60', NULL, '', '', ''),
(5, 'PB 25.10.16', NULL, '', '', ''), (6, 'PB Section 12', NULL, '', '', '12'), (7, 'SB 1.2.3.4', NULL, '', '', ''), (8, 'Hymn 12 (To Dawn)', 'To Dawn', '', '', ''), (9, 'Book IV', NULL, '', '', ''),
(10, NULL, NULL, '', '', ''), (11, NULL, NULL, '', '', ''), (12, NULL, NULL, NULL, NULL, NULL)) v(id, citation, head, book, canto, section)""",
    "enriched_kinds": """SELECT * FROM (VALUES
(1, 'II', 'XIV', NULL, NULL, NULL, 'Book II. Canto XIV. # Book II.' || chr(10) || '## Canto XIV. The Vow.' || chr(10) || '[007] He spoke.'), (2, NULL, NULL, NULL, NULL, NULL, '## [05-061] HYMN LXI. Maruts.'),
(3, NULL, NULL, NULL, NULL, NULL, 'as RV 7.18.9 says'), (4, NULL, NULL, NULL, NULL, NULL, 'VSM 3.60 and more'), (5, NULL, NULL, NULL, NULL, NULL, 'PBr. XXV. 10. 16 tells'), (6, NULL, NULL, '12', NULL, NULL, 'Section 12. 12. They went on'),
(7, NULL, NULL, NULL, NULL, NULL, 'Satapatha 1.2.3.4'), (8, NULL, NULL, NULL, NULL, NULL, '### Hymn 12: To Dawn'), (9, NULL, NULL, NULL, NULL, NULL, 'Book IV'), (10, NULL, NULL, NULL, NULL, NULL, 'nothing'),
(11, NULL, NULL, NULL, 'sanskrit', 11, 'अग्निम् ईळे'), (12, NULL, NULL, NULL, NULL, NULL, NULL)) v(id, book, canto, pb_section, preprocessing, original_content_length, text)""",
    "kg_stored": f"""
WITH f AS (SELECT *, {KEY.format('subject')} AS sk, {KEY.format('object')} AS ok FROM kg_seed WHERE relation IN (SELECT DISTINCT relation FROM {EDGES}) AND subject IS NOT NULL AND object IS NOT NULL)
SELECT DISTINCT sk AS subject_key, relation, ok AS object_key FROM f WHERE (sk, relation, ok) NOT IN (SELECT (sk, relation, ok) FROM f WHERE fact_id % 7 = 0)""",
    "answer_scores": "SELECT user_id, count(*) FILTER (event_type = 'purchase') AS \"right\", count(*) AS answers FROM events GROUP BY 1",
    "edition_verses": """SELECT * FROM (VALUES
('AVS', '5.22.1', 'अग्निस् तक्मानम् वेदिर् बर्हिः'), ('AVS', '2.17.1', 'ओजो मे दाः स्वाहा'), ('PB', '1.1.1', 'महन् मे'), ('PB', '1.1.2', 'भर्गो मे'), ('PB', '2.1.1', 'अग्ने'),
('SB', '1.1.1.1', 'व्रतम् उपैष्यन् अन्तरेण'), ('SB', '1.1.1.2', 'अप उपस्पृशति'), ('RV', '1.1.1', 'अग्निम् ईऌए । पुरोहितम्'), ('RV', '1.1.2', 'होतारम्'),
('AB', '7.1.1', 'हरिश्चन्द्रो ह'), ('AB', '7.1.2', 'तस्य ह'), ('VS', '1.1', 'इषे त्वा ऊर्जे त्वा'), ('VS', '1.2', 'वसोः पवित्रम्'), ('TS', '1.1.1.1', 'इषे त्वा ऊर्जे त्वा'), ('TS', '1.1.2.1', 'यज्ञस्य घोषद् असि')) v(work, address, text)""",
    "edition_markdown": """SELECT * FROM (VALUES ('7/1/1/0', '# AB 7'), ('7/1/1/1', '## AB 7.1'), ('7/1/1/2', 'हरिश्चन्द्रो ह ॥ AB 7.1.1 ॥'), ('7/1/2/2', 'तस्य ह ॥ AB 7.1.2 ॥')) v(line_no, text)""",
    "edition_chunks": """SELECT 'rv' AS filename, '1.1' AS section, 0 AS pos, '## RV 1.1' || chr(10) || chr(10) || 'अग्निम् ईऌए । पुरोहितम् ॥ RV 1.1.1 ॥' || chr(10) || 'होतारम् ॥ RV 1.1.2 ॥' AS page_content, 2 AS layer""",
    "keyword_queries": fact(r"""CASE WHEN length(CASE WHEN regexp_matches(subject, '[\x{0900}-\x{097F}]') THEN kept ELSE plain END) < 2 THEN subject WHEN regexp_matches(subject, '[\x{0900}-\x{097F}]') THEN kept ELSE plain END""").replace(
        "FROM kg_seed WHERE subject IS NOT NULL",
        r"FROM (SELECT *, trim(regexp_replace(strip_accents(kept), '[^\p{L}\p{N}_\s\x{0B}\[\]\-]', '', 'g'), ' ') AS plain FROM (SELECT *, trim(array_to_string(list_filter(regexp_extract_all(subject, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]+'), lambda w: NOT list_contains(["
        + lst("summarize explain describe tell about what who when where why how is are the a an in on at for".split())
        + r"], lower(w))), ''), ' ') AS kept FROM kg_seed WHERE subject IS NOT NULL))",
    ),
    "model_terms": fact(
        "array_to_string((SELECT list_filter(t, lambda x, i: x <> '' AND length(x) <= 30 AND list_position(t, x) = i) FROM (SELECT list_transform(list_filter(list_transform(regexp_split_to_array(subject, '[,\n;]+'), lambda x: trim(x, ' ')), "
        "lambda x: x <> '')[:20], lambda x: regexp_replace(regexp_replace(x, '[^A-Za-zāīūṛṝḷḹṃḥśṣṭḍṇñṅ-]', '', 'g'), '^-+|-+$', '', 'g')) AS t)), '|')"
    ),
    "noun_expansion": f"""
WITH r AS (SELECT * FROM {ranked_sql('river hymn singer altar the the', 40)}),
f AS (SELECT 0 AS noun, * FROM {bm25_sql('Nubāḥ Nubāḥ.', 15)} UNION ALL SELECT 1, * FROM {bm25_sql('Gam Gam.', 15)} UNION ALL SELECT 2, * FROM {bm25_sql('nosuchnoun', 15)}),
m AS (SELECT doc_id, min((noun, -score)) AS b FROM f WHERE doc_id NOT IN (SELECT doc_id FROM r) GROUP BY 1),
k AS (SELECT doc_id, b FROM m QUALIFY row_number() OVER (PARTITION BY b[1] ORDER BY b, doc_id) = 1)
SELECT doc_id, pos FROM r WHERE pos < 15 UNION ALL SELECT doc_id, row_number() OVER (ORDER BY b) + 14 FROM k""",
    "kg_question_context": f"""
WITH RECURSIVE e AS (SELECT * FROM {EDGES}), g AS (SELECT DISTINCT replace(strip_accents(lower(subject)), '-', '') AS key FROM e WHERE NOT regexp_matches(subject, '\\s')),
w AS (SELECT DISTINCT fact_id, unnest(regexp_extract_all(object, '\\p{{L}}[\\p{{L}}\\p{{M}}-]{{2,}}')) AS w FROM kg_seed WHERE object IS NOT NULL AND fact_id % 20 = 0),
f AS (SELECT DISTINCT fact_id, {KEY.format('w')} AS k FROM w WHERE replace(strip_accents(lower(w)), '-', '') IN (SELECT key FROM g)),
h AS (SELECT fact_id, e.subject_key, e.relation, e.object_key, 1 AS hop FROM f JOIN e ON e.subject_key = k
  UNION SELECT fact_id, e.subject_key, e.relation, e.object_key, hop + 1 FROM h JOIN e ON e.subject_key = h.object_key WHERE hop < 2)
SELECT fact_id, subject_key, relation, object_key, min(hop) AS hop FROM h GROUP BY ALL""",
}
