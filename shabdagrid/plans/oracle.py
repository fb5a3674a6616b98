"""The same queries in DuckDB SQL, written from the definitions of the operators."""

from __future__ import annotations

# The values are written out here once more, not imported: a slip in those of the operators then shows as a difference.
QUERY = 'river hymn singer altar the the'
TERMS = ['river', 'hymn', 'yāga', 'Nubāḥ', 'refrain', 'ladle']
SCAN_TERMS = ['पुध', 'यमीनः', 'pudha']
DEVANAGARI = r"[\x{0900}-\x{097F}]"
IAST_LETTERS = 'āīūṛṝḷḹṃḥśṣṭḍṅñ'
WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
VERSE_ID = r"॥\s*((?:[A-Z]{2,4} )?\d+\.\d+\.\d+)\s*॥"
MARKER = r"(?:॥|।।|\|\|)\s*((?:[A-Z]{2} )?\d+\.\d+\.\d+)\s*(?:॥|।।|\|\|)\s*$"
NOUN_ENDINGS = [
    'asya', 'enas', 'aya', 'ena', 'ah', 'am', 'at', 'au', 'as', 'a', 'e',
]
NOT_NAMES = (
    "What When Where Which Who Whom Whose Why How I You He She It We They This That These Those And But Or Nor For Yet So If Then Because In On "
    "At By With From To Of Into Through During Before After Above Below Between Among The A An Is Are Was Were Be Been Being Have Has Had Do Does "
    "Did Will Would Could Should May Might Must Can War Wars Battle Battles King Kings Queen Queens Hymn Hymns Book Books Chapter Chapters Ten "
    "Twenty Thirty Forty Fifty Hundred Thousand Tell Explain Describe Name List Give Show Find All Some Any Each Every Both Either Neither Many "
    "Few Several Shall "
).split()
COMPARATIVE = [
    'both', 'compare', 'comparison', 'versus', 'vs', 'between', 'earlier', 'later', 'across', 'layers', 'evolve', 'evolution', 'over time',
    'diachronic',
]
CONSTRUCTION = [
    'how do i say', 'translate to sanskrit', 'what is', 'in sanskrit', 'how to say', 'say in vedic', 'sanskrit for', 'vedic word for', 'translate',
    'in devanagari', 'construct',
]
GRAMMAR = [
    'explain', 'what is the rule', 'how does', 'why', 'grammar', 'declension', 'conjugation', 'sandhi', 'vibhakti', 'case ending', 'verb form',
    'how to form',
]
LOCATION = [
    'where', 'location', 'place', 'river', 'cross', 'dwell', 'lived', 'live', 'settled', 'settlement', 'bank',
]
TRIBAL = [
    'tribe', 'enemy', 'enemies', 'ally', 'allies', 'fought with', 'fought against', 'confederat', 'coalition', 'ten kings',
]
FOLLOW_UP = [
    'this verse', 'that verse', 'the verse', 'this line', 'that line', 'this hymn', 'that hymn', 'this reading', 'your reading',
    'your interpretation', 'you said', 'you interpret', 'why do you', 'why did you', 'how do you', 'justif', 'differ', 'instead of', 'epithet',
    'proper noun', 'not a name', 'same verse', 'translate it', 'interpret it', 'its meaning', 'the meaning', 'word-by-word', 'word by word', 'sandhi',
    'grammar', ' it ', ' its ',
]
RELATIONS = (
    "has_son has_daughter has_father has_mother has_brother has_sister has_spouse member_of_dynasty founded_dynasty patronymic epithet is_king_of "
    "is_purohita_of is_disciple_of is_guru_of fought allied_with performed_ritual received_boon same_as located_at flows_through "
    "associated_with_place originates_from disappears_at dwells_on has_attribute "
).split()
SINGLETONS = (
    "has_father has_mother is_king_of located_at disappears_at originates_from "
).split()
INVERSES = {
    "has_son": "has_father",
    "has_daughter": "has_father",
    "has_father": "has_son",
    "has_mother": "has_son",
    "has_brother": "has_brother",
    "has_sister": "has_sister",
    "has_spouse": "has_spouse",
    "same_as": "same_as",
    "is_disciple_of": "is_guru_of",
    "is_guru_of": "is_disciple_of",
    "fought": "fought",
    "allied_with": "allied_with",
}
PATTERNS = [
    (r"\[(\d{2})-(\d{3})\]\s+(?:HYMN|BOOK|CANTO)", "RV {i1}.{i2}"),
    (r"(?:Hymn|RV|Rigveda)\s+(\d+)\.(\d+)(?:\.(\d+))?", "RV {1}.{2}{.3}"),
    (r"VS[A-Z]*\s+(\d+)\.(\d+)", "YV {1}.{2}"),
    (r"(?:YV|Yajurveda|Verse)\s+(\d+)\.(\d+)", "YV {1}.{2}"),
    (r"PBr\.\s+([0-9]+|[IVX]+)\s*\.\s*(\d+)(?:\s*\.\s*(\d+))?", "PB {r1}.{2}{.3}"),
    (r"^\s*(\d+)\.\s+(?:By means of|They|The|At|This)", "PB Section {1}"),
    (r"(?:Satapatha|SB|Brahmana)\s+(\d+)\.(\d+)\.(\d+)(?:\.(\d+))?", "SB {1}.{2}.{3}{.4}"),
    (r"(?:Mantra|Sukta|Adhyaya)\s+(\d+)", "Unknown Reference"),
    (r"^#+\s*(?:Hymn|Verse|Sutra|Section|Book|Mandala)\s+(\d+)(?:[:\-]\s*(.+))?", "Hymn {1}{ (2)}"),
    (r"(?:Book|Canto|Adhyaya)\s+([IVX]+|\d+)", "Book {1}"),
]

q = lambda s: "'" + s.replace("'", "''") + "'"
lst = lambda xs: ", ".join(q(x) for x in xs)


def bm25_sql(query: str, k: int) -> str:
    """A subquery (doc_id, score) of the top k."""
    terms = ", ".join(f"({q(t)}, {query.split().count(t)})" for t in dict.fromkeys(query.split()))
    return f"""(
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
st AS (SELECT count(*) AS n, avg(len(w)) AS m FROM d),
df AS (SELECT t, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(w) AS t FROM d) GROUP BY t),
mi AS (SELECT avg(ln(n - df + 0.5) - ln(df + 0.5)) AS mi FROM df, st),
qt AS (SELECT * FROM (VALUES {terms}) v(t, c)),
wt AS (SELECT qt.t, c * CASE WHEN ln(n - df + 0.5) - ln(df + 0.5) >= 0 THEN ln(n - df + 0.5) - ln(df + 0.5) ELSE 0.25 * mi END AS wt FROM qt JOIN df USING (t), st, mi),
p AS (SELECT doc_id, t, len(w) AS dl, len(list_filter(w, lambda x: x = t)) AS tf FROM d, wt)
SELECT doc_id, round(sum(wt * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / m))), 9) AS score
FROM p JOIN wt USING (t), st WHERE tf > 0 GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT {k})"""


def ranked_sql(query: str, k: int) -> str:
    return f"(SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS pos FROM {bm25_sql(query, k)})"


def dense_sql(where: str = "true") -> str:
    return f"""(SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)), 6) AS score
FROM embeddings WHERE {where} ORDER BY score DESC, vec_id LIMIT 15)"""


def fuse_sql(semantic: str, keyword: str) -> str:
    """(text, score, arrival) of two subqueries (text, pos)."""
    return f"""(
WITH s0 AS (SELECT text, row_number() OVER (ORDER BY pos) - 1 AS i, count(*) OVER () AS n FROM {semantic}),
k0 AS (SELECT text, row_number() OVER (ORDER BY pos) - 1 AS i, count(*) OVER () AS n FROM {keyword}),
s AS (SELECT text, min((n - i) * 0.7) AS sv, min(i) AS si FROM s0 GROUP BY text),
k AS (SELECT text, sum((n - i) * 0.3) AS kv, max((n - i) * 0.3) AS kf, min(i) AS ki FROM k0 GROUP BY text)
SELECT coalesce(s.text, k.text) AS text, round(CASE WHEN sv IS NULL THEN 2 * kv - kf ELSE sv + 2 * coalesce(kv, 0) END, 6)::DOUBLE AS score,
  coalesce(si, 1000000 + ki) AS arrival
FROM s FULL JOIN k ON s.text = k.text)"""


LINES = """(SELECT file, line_no, (max_by({'t': text}, (loaded_at, coalesce(text, '')))).t AS text, count(*) AS versions FROM corpus_line GROUP BY file, line_no)"""
HEADED = f"(SELECT *, nullif(regexp_extract(text, '^## (.*)$', 1), '') AS h, nullif(regexp_extract(text, '^# (.*)$', 1), '') AS b FROM {LINES})"
VERSES = f"""(SELECT file, line_no, regexp_extract(vid, '^([A-Z]{{2}})', 1) AS corpus, regexp_extract(vid, '(\\d+)\\.(\\d+)\\.(\\d+)$', 1)::INT AS book,
  regexp_extract(vid, '(\\d+)\\.(\\d+)\\.(\\d+)$', 2)::INT AS hymn, regexp_extract(vid, '(\\d+)\\.(\\d+)\\.(\\d+)$', 3)::INT AS verse, trim(regexp_replace(text, '{MARKER}', '')) AS text
  FROM (SELECT *, regexp_extract(text, '{MARKER}', 1) AS vid FROM {LINES} WHERE text IS NOT NULL) WHERE vid <> '')"""
CHUNK_LINES = f"""(SELECT chunk_id, n, trim(a[n + 1]) AS line, regexp_extract(a[n + 1], '{VERSE_ID}\\s*$', 1) AS vid
  FROM (SELECT chunk_id, a, unnest(range(len(a))) AS n FROM (SELECT chunk_id, regexp_split_to_array(page_content, '\\r?\\n') AS a FROM chunk WHERE page_content IS NOT NULL)))"""
CONCORD = f"""(SELECT regexp_extract(vid, '^([A-Z]+)', 1) AS corpus, vid, min_by(line, (chunk_id, n)) AS line FROM {CHUNK_LINES}
  WHERE vid <> '' AND ({' OR '.join(f'contains(line, {q(t)})' for t in SCAN_TERMS)}) GROUP BY vid)"""
KEY = "trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', '_', 'g'), '_')"
TRUST = "(CASE provenance WHEN 'authoritative' THEN 3 WHEN 'itihasa' THEN 2 ELSE 1 END)"
EDGES = f"""(
WITH f AS (SELECT *, {KEY.format('subject')} AS sk, {KEY.format('object')} AS ok, {TRUST} AS tr FROM kg_seed
  WHERE relation IN ({lst(RELATIONS)}) AND subject IS NOT NULL AND object IS NOT NULL),
cf AS (SELECT sk, relation, ok, citation, min(fact_id) AS i FROM f WHERE citation IS NOT NULL AND trim(citation) <> '' GROUP BY ALL),
c AS (SELECT sk, relation, ok, list(citation ORDER BY i) AS citations FROM cf GROUP BY ALL),
g AS (SELECT sk, relation, ok, min(fact_id) AS first_seq, max(tr) AS trust, min((-tr, fact_id)) AS best, min_by(subject, fact_id) AS subject, min_by(object, fact_id) AS object FROM f GROUP BY sk, relation, ok),
r AS (SELECT *, row_number() OVER (PARTITION BY sk, relation ORDER BY best) AS r FROM g)
SELECT r.sk AS subject_key, r.relation, r.ok AS object_key, subject, object, coalesce(citations, []) AS citations, trust, first_seq
FROM r LEFT JOIN c ON r.sk = c.sk AND r.relation = c.relation AND r.ok = c.ok WHERE r.relation NOT IN ({lst(SINGLETONS)}) OR r.r = 1)"""
_consonants = "[" + ", ".join(q(c) for c in "कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसहळ") + "]"
_latin = "[" + ", ".join(q(c) for c in "k kh g gh ṅ c ch j jh ñ ṭ ṭh ḍ ḍh ṇ t th d dh n p ph b bh m y r l v ś ṣ s h ḻ".split()) + "]"
_vowels = "['अ', 'आ', 'इ', 'ई', 'उ', 'ऊ', 'ऋ', 'ॠ', 'ऌ', 'ॡ', 'ए', 'ऐ', 'ओ', 'औ', 'ा', 'ि', 'ी', 'ु', 'ू', 'ृ', 'ॄ', 'ॢ', 'ॣ', 'े', 'ै', 'ो', 'ौ', 'ं', 'ः', '्']"
_vowels_latin = "['a', 'ā', 'i', 'ī', 'u', 'ū', 'ṛ', 'ṝ', 'ḷ', 'ḹ', 'e', 'ai', 'o', 'au', 'ā', 'i', 'ī', 'u', 'ū', 'ṛ', 'ṝ', 'ḷ', 'ḹ', 'e', 'ai', 'o', 'au', 'ṃ', 'ḥ', '']"


def latin_sql(token: str) -> str:
    """A token of letters romanised: a consonant carries an a unless a vowel sign or a virama follows."""
    ch, after = f"substring({token}, i, 1)", f"substring({token}, i + 1, 1)"
    return (
        f"array_to_string(list_transform(range(1, length({token}) + 1), lambda i: CASE WHEN list_contains({_consonants}, {ch}) "
        f"THEN {_latin}[list_position({_consonants}, {ch})] || CASE WHEN regexp_matches({after}, '[ा-ौॢॣ्]') THEN '' ELSE 'a' END "
        f"ELSE coalesce({_vowels_latin}[list_position({_vowels}, {ch})], {ch}) END), '')"
    )


def lexicon_sql(table: str, text: str) -> str:
    """A subquery (kind, key, tokens)."""
    return f"""(
WITH t AS (SELECT DISTINCT token FROM (SELECT unnest(regexp_extract_all(lower({text}), '[\\p{{L}}][\\p{{L}}\\p{{M}}]+')) AS token FROM {table}) WHERE length(token) >= 3),
r AS (SELECT token, {latin_sql('token')} AS x FROM t),
k AS (SELECT token, {SEARCH_KEY.format('x')} AS key FROM r),
b AS (SELECT 'primary' AS kind, key, token FROM k WHERE length(key) >= 3 UNION ALL SELECT 'skeleton', replace(key, 'sh', 's'), token FROM k WHERE length(key) >= 3)
SELECT kind, key, list_sort(list_distinct(list(token))) AS tokens FROM b GROUP BY kind, key)"""


_lookup_tests = [
    (m, k, i, f"kind = '{('primary', 'skeleton')[k]}' AND " + (f"key = '{c}'", f"starts_with(key, '{c}')", f"contains(key, '{c}')")[m])
    for m in range(3)
    for k in range(2)
    for i, c in enumerate(("river", "sing"))
]
TERM_COUNT = lambda t, c="text": f"((length({c}) - length(replace({c}, {q(t)}, ''))) // {len(t)})"
STEM = "CASE WHEN length(x) <= 2 THEN x " + " ".join(f"WHEN lower(x) LIKE '%{e}' AND length(x) > {len(e) + 2} THEN x[:-{len(e) + 1}]" for e in NOUN_ENDINGS) + " ELSE x END"
PLAIN_FROM, PLAIN_TO = "āīūṛṝḷḹēōṃḥṅñṇṭḍśṣĀĪŪṚṜḶḸĒŌṂḤṄÑṆṬḌŚṢ", "aiurrlleomhnnntdssAIURRLLEOMHNNNTDSS"
SEARCH_KEY = "trim(lower({0}), ' ')"
for _k, _v in (("ṝ", "ri"), ("ṛ", "ri"), ("ḹ", "li"), ("ṃ", "m"), ("ṁ", "m"), ("ḥ", ""), ("ś", "sh"), ("ṣ", "sh"), ("ḷ", "l")):
    SEARCH_KEY = f"replace({SEARCH_KEY}, '{_k}', '{_v}')"
SEARCH_KEY = f"regexp_replace(strip_accents(replace(replace(replace({SEARCH_KEY}, 'ch', chr(1)), 'c', 'ch'), chr(1), 'chh')), '[^a-z]', '', 'g')"
WORDS = f"""(SELECT fact_id, i - 1 AS pos, w[i] AS word FROM (SELECT fact_id, w, unnest(range(1, len(w) + 1)) AS i FROM (
SELECT fact_id, list_filter(regexp_split_to_array(subject, '{WS}+'), lambda x: x <> '') AS w FROM kg_seed WHERE subject IS NOT NULL)))"""
_sk = SEARCH_KEY.format("word")
_rom = "trim(lower(word), ' ')"
_va = f"replace(replace({_rom}, 'ksh', 'kṣ'), 'sh', 'ś')"
_vb = f"replace({_va}, 'ch', 'c')"
SECTIONS = lambda x: f"regexp_extract({x}, '^(.*)\\.\\d+$', 1)"
_terms_case = lambda c: ", ".join(f"CASE WHEN contains({c}, {q(t)}) THEN 1 ELSE 0 END" for t in TERMS)
doc = lambda e: f"SELECT doc_id, {e} AS value FROM documents WHERE text IS NOT NULL"
fact = lambda e: f"SELECT fact_id, {e} AS value FROM kg_seed WHERE subject IS NOT NULL"
SPEECH = r"trim(regexp_replace(regexp_replace(regexp_replace(text, '॥[^॥]*॥', ' ', 'g'), '[।॥|/\\\[\]{}()<>*_#0-9०-९]', ' ', 'g'), '[\s\x{0B}]+', ' ', 'g'), ' ')"
ROMAN_VALUE = lambda x: f"[1, 5, 10, 50, 100, 500, 1000][strpos('IVXLCDM', {x})]"
ROMAN = lambda c: (
    f"coalesce(list_sum(list_transform(range(1, length({c}) + 1), lambda i: {ROMAN_VALUE(f'{c}[i]')} * "
    f"CASE WHEN i < length({c}) AND {ROMAN_VALUE(f'{c}[i]')} < {ROMAN_VALUE(f'{c}[i + 1]')} THEN -1 ELSE 1 END)), 0)"
)


def citation_sql(text: str) -> str:
    """The first pattern's label as a CASE chain."""
    cases = []
    for pattern, label in PATTERNS:
        rx = "(?im)" + pattern
        g = lambda n: f"regexp_extract({text}, {q(rx)}, {n})"  # noqa: E731, B023
        parts, rest = [], label
        while "{" in rest:
            before, _, tail = rest.partition("{")
            spec, _, rest = tail.partition("}")
            parts += [q(before)] if before else []
            n = int("".join(ch for ch in spec if ch.isdigit()))
            if spec[0] == "i":
                parts.append(f"{g(n)}::INT::VARCHAR")
            elif spec[0] == "r":
                parts.append(f"CASE WHEN regexp_matches({g(n)}, '^[IVX]+$') THEN {ROMAN(g(n))}::VARCHAR ELSE {g(n)} END")
            elif spec[0] == ".":
                parts.append(f"CASE WHEN {g(n)} <> '' THEN '.' || {g(n)} ELSE '' END")
            elif spec[0] == " ":
                parts.append(f"CASE WHEN {g(n)} <> '' THEN ' (' || {g(n)} || ')' ELSE '' END")
            else:
                parts.append(g(n))
        parts += [q(rest)] if rest else []
        cases.append(f"WHEN regexp_matches({text}, {q(rx)}) THEN {' || '.join(parts)}")
    return "CASE " + " ".join(cases) + " END"
VARIANTS = """(SELECT canonical, category, unnest(list_distinct([canonical] || coalesce(variants, []))) AS f, list_position(['given_name', 'place', 'tribe', 'deity'], category) AS o FROM proper_noun WHERE canonical IS NOT NULL)"""
VARIANT_INDEX = f"(SELECT f AS variant, max_by(canonical, (coalesce(o, 0), canonical)) AS canonical, max_by(category, (coalesce(o, 0), canonical)) AS category FROM {VARIANTS} GROUP BY f)"

_any = lambda c, ps: "(" + " OR ".join(f"contains(lower({c}), {q(p)})" for p in ps) + ")"

NAMES = r"regexp_extract(text, '(?i)\[Names\s*\([^)]*\):\s*([^\]]+)\]', 1)"
HEAD = r"regexp_extract(text, '(?im)^#+\s*(?:Hymn|Verse|Sutra|Section)?\s*[\d:]*\s*(.+?)$', 1)"
TITLE = f"CASE WHEN {NAMES} <> '' THEN trim(split_part({NAMES}, ',', 1), ' ') WHEN {HEAD} <> '' THEN trim({HEAD}, ' ') END"

LEX = lexicon_sql("documents", "text")

ORACLE: dict[str, str] = {
    "lexicon_devanagari": f"SELECT * FROM {lexicon_sql('chunk', 'page_content')}",
    "section_titles": doc(TITLE),
    "citation_labels": f"SELECT doc_id, CASE WHEN c IS NULL THEN 'Passage 1' ELSE concat_ws(' - ', c, t) END AS value FROM (SELECT doc_id, {citation_sql('left(text, 500)')} AS c, {TITLE} AS t FROM documents WHERE text IS NOT NULL)",
    "speech_text": doc(SPEECH),
    "roman_numbers": f"SELECT p_partkey, {ROMAN('r')}::INT AS value FROM (SELECT p_partkey, upper(regexp_extract(p_name, '(?i)([ivxlcdm]+)', 1)) AS r FROM part)",
    "citation_extract": doc(citation_sql("text")),
    "question_modes": doc(
        r"CASE WHEN regexp_matches(text, '(?i)(earlier|early|later|late|older|newer)[^.?]*\b(vedic|veda|period|layer|mandala|time)|evolv|over time|diachronic|through time|chronolog') THEN 'diachronic' "
        r"WHEN regexp_matches(text, '(?i)\b(which|all|every|list)\b') AND regexp_matches(text, '(?i)\b(verse|verses|hymn|hymns|passage|passages)\b') THEN 'concordance' ELSE 'plain' END"
    ),
    "query_types": doc(f"CASE WHEN {_any('text', CONSTRUCTION)} THEN 'construction' WHEN {_any('text', GRAMMAR)} THEN 'grammar' ELSE 'factual' END"),
    "follow_ups": doc(_any("text", FOLLOW_UP)),
    "place_expansion": doc(f"concat_ws('|', CASE WHEN {_any('text', LOCATION)} THEN 'Asānadī|Ditpura' END, CASE WHEN {_any('text', TRIBAL)} THEN 'Dikātsu' END)"),
    "enriched_queries": doc("concat_ws(' ', text, CASE WHEN contains(lower(text), 'river') THEN 'nadī sindhu' END, CASE WHEN contains(lower(text), 'fire') THEN 'agni' END, CASE WHEN contains(lower(text), 'king') THEN 'rājan' END)"),
    "edition_marks": fact("trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(subject, '[''՚]\\d*', '', 'g'), '\\\\|//', ' ', 'g'), '[=+]', '', 'g'), ' {2,}', ' ', 'g'), ' ')"),
    "enriched_chunks": f"""SELECT chunk_id, CASE WHEN regexp_matches(page_content, '{DEVANAGARI}') THEN 'sanskrit' END AS preprocessing,
CASE WHEN regexp_matches(page_content, '{DEVANAGARI}') THEN length(page_content) END AS original_content_length, page_content FROM chunk""",
    "bm25_topk": f"SELECT * FROM {bm25_sql(QUERY, 15)}",
    "bm25_indexed": f"SELECT * FROM {bm25_sql(QUERY, 15)}",
    "dense_topk": f"SELECT * FROM {dense_sql()}",
    "dense_topk_filtered": f"SELECT * FROM {dense_sql('label = 1')}",
    "rank_fusion": f"""SELECT (SELECT min(doc_id) FROM documents x WHERE x.text = f.text) AS doc_id, score, arrival
FROM {fuse_sql(f'(SELECT text, pos FROM {ranked_sql("river hymn", 40)} JOIN documents USING (doc_id))', f'(SELECT text, pos FROM {ranked_sql("hymn singer", 40)} JOIN documents USING (doc_id))')} f""",
    "hybrid_search": f"""
WITH k AS (SELECT * FROM {ranked_sql(QUERY, 15)}),
s AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS pos FROM {dense_sql()}),
ids AS (SELECT doc_id FROM k UNION SELECT doc_id FROM s),
f AS (SELECT * FROM {fuse_sql("(SELECT text, pos FROM s JOIN documents USING (doc_id) WHERE text IS NOT NULL)", "(SELECT text, pos FROM k JOIN documents USING (doc_id) WHERE text IS NOT NULL)")}),
b AS (SELECT text, arrival, score * CASE WHEN (length(left(text, 1000)) - length(regexp_replace(left(text, 1000), '{DEVANAGARI}', '', 'g'))) / greatest(1, length(left(text, 1000))) > 0.05 THEN 2.5 ELSE 1 END AS score FROM f),
r AS (SELECT (SELECT min(doc_id) FROM documents x JOIN ids USING (doc_id) WHERE x.text = b.text) AS doc_id, round(score, 6)::DOUBLE AS score, row_number() OVER (ORDER BY round(score, 6) DESC, arrival) - 1 AS pos FROM b)
SELECT doc_id, score, pos FROM r WHERE pos < 17""",
    "score_boosts": f"""SELECT doc_id, round(score * CASE WHEN o AND NOT t THEN 2.5 WHEN t AND NOT o THEN 0.6 ELSE 1 END * CASE WHEN p AND NOT c THEN 2.0 WHEN c AND NOT p THEN 0.5 ELSE 1 END, 6) AS score FROM (
SELECT doc_id, score, (length(left(text, 1000)) - length(regexp_replace(left(text, 1000), '{DEVANAGARI}', '', 'g'))) / greatest(1, length(left(text, 1000))) > 0.05 AS o,
coalesce(lower(lang) = 'en', false) AS t, coalesce(starts_with(filename, 'v'), false) AS p, coalesce(starts_with(filename, 'kp'), false) AS c FROM {bm25_sql(QUERY, 60)} JOIN documents USING (doc_id))""",
    "source_filter_strict": f"""SELECT doc_id, row_number() OVER (ORDER BY pos) - 1 AS pos FROM {ranked_sql(QUERY, 60)} JOIN documents USING (doc_id)
WHERE coalesce(contains(lower(veda), 'vanaveda'), false) OR coalesce(contains(lower(filename), 'vanaveda'), false)""",
    "source_filter_soft": f"""SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN coalesce(contains(lower(veda), 'nadiveda'), false) OR coalesce(contains(lower(filename), 'nadiveda'), false) THEN 0 ELSE 1 END, pos) - 1 AS pos
FROM {ranked_sql(QUERY, 60)} JOIN documents USING (doc_id)""",
    "source_filter_fallback": f"SELECT doc_id, pos FROM {ranked_sql(QUERY, 60)}",
    "detected_sources": f"""SELECT doc_id, list_filter([CASE WHEN regexp_matches(t, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])(vana samhita|vn)($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])') THEN 'vanaveda' END, CASE WHEN regexp_matches(t, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])(nadi samhita|nd)($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])') THEN 'nadiveda' END,
CASE WHEN regexp_matches(t, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])(kapila brahmana|kp)($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])') THEN 'kapila_brahmana' END], lambda x: x IS NOT NULL) AS sources,
len(sources) = 1 AND NOT ({' OR '.join(f'contains(t, {q(w)})' for w in COMPARATIVE)}) AS strict FROM (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL)""",
    "variant_union_dedup": f"""SELECT variant, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY left(text, 200) ORDER BY variant, doc_id) AS r FROM (
{' UNION ALL '.join(f"SELECT {i} AS variant, doc_id, text FROM documents WHERE contains(text, {q(w)})" for i, w in enumerate(('river', 'hymn', 'पुध')))})) WHERE r = 1""",
    "anti_backfill": f"""WITH a AS (SELECT doc_id, text, pos FROM {ranked_sql(QUERY, 15)} JOIN documents USING (doc_id)), m AS (SELECT doc_id, text, pos FROM {ranked_sql('refrain river', 30)} JOIN documents USING (doc_id))
SELECT doc_id, row_number() OVER (ORDER BY p, pos) - 1 AS pos FROM (SELECT 0 AS p, * FROM a UNION ALL SELECT 1, * FROM m WHERE NOT EXISTS (SELECT 1 FROM a WHERE left(a.text, 200) = left(m.text, 200)))""",
    "layer_interleave": f"""
WITH s AS (SELECT chunk_id, metadata.chronology_layer AS layer, 1000 * list_sum([{', '.join(f'CASE WHEN contains(page_content, {q(t)}) THEN 1 ELSE 0 END' for t in SCAN_TERMS)}]) + {' + '.join(TERM_COUNT(t, 'page_content') for t in SCAN_TERMS)} AS score FROM chunk WHERE page_content IS NOT NULL),
p AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) - 1 AS pos FROM s WHERE score > 0 ORDER BY score DESC, chunk_id LIMIT 40),
r AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY pos) AS r, (SELECT count(DISTINCT layer) FROM p) >= 2 AS known FROM p),
o AS (SELECT *, known AND layer IS NOT NULL AND r <= 4 AS f FROM r)
SELECT chunk_id, layer, row_number() OVER (ORDER BY CASE WHEN f THEN 0 ELSE 1 END, CASE WHEN f THEN r ELSE 0 END, CASE WHEN f THEN layer END NULLS FIRST, pos) - 1 AS pos FROM o""",
    "lexical_score": f"SELECT * FROM (SELECT doc_id, list_sum([{_terms_case('text')}])::INT AS n_terms, {' + '.join(TERM_COUNT(t) for t in TERMS)} AS hits, 1000 * n_terms + hits AS score FROM documents WHERE text IS NOT NULL) WHERE n_terms > 0",
    "term_df": " UNION ALL ".join(f"SELECT {q(t)} AS term, count(*) FILTER (contains(text, {q(t)})) AS df FROM documents" for t in TERMS),
    "concordance": f"SELECT corpus, vid, line, count(*) OVER () AS total FROM {CONCORD}",
    "concordance_page": f"""SELECT vid, total FROM (SELECT *, count(*) OVER () AS total, list_transform(string_split(regexp_extract(vid, '(\\d+\\.\\d+\\.\\d+)$', 1), '.'), lambda x: x::INT) AS path FROM {CONCORD}) ORDER BY corpus, path LIMIT 60""",
    "lexicon_build": f"SELECT * FROM {LEX}",
    "lexicon_lookup": f"""
WITH l AS (SELECT * FROM {LEX}), h AS ({' UNION ALL '.join(f'SELECT {m} AS m, {k} AS k, {i} AS i, key, tokens FROM l WHERE {c}' for m, k, i, c in _lookup_tests)}),
r AS (SELECT *, row_number() OVER (PARTITION BY m, k, i ORDER BY length(key), key) AS r FROM h),
t AS (SELECT (m, k, i, r, p) AS o, m, tokens[p] AS token FROM (SELECT *, unnest(range(1, least(4, len(tokens)) + 1)) AS p FROM r WHERE r <= 6)),
f AS (SELECT token, min(o) AS o, min_by(m, o) AS m FROM t GROUP BY token),
b AS (SELECT m, coalesce(sum(count(*)) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f GROUP BY m)
SELECT token, row_number() OVER (ORDER BY o) - 1 AS pos FROM f JOIN b USING (m) WHERE before < 12 ORDER BY o LIMIT 12""",
    "verse_lookup": f"SELECT chunk_id, vid, line FROM {CHUNK_LINES} WHERE starts_with(vid, 'KP 2.')",
    "neighbour_window": f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no) - 1 AS n FROM {LINES})
SELECT f.file, f.n AS focus_no, r.n AS row_no, r.line_no FROM r JOIN r f ON r.file = f.file AND r.n BETWEEN greatest(0, f.n - 15) AND greatest(0, f.n - 15) + 29 WHERE contains(f.text, 'यमीनः')""",
    "context_expansion": f"""
WITH z AS (SELECT chunk_id, page_content, 1000 * list_sum([{', '.join(f'CASE WHEN contains(page_content, {q(t)}) THEN 1 ELSE 0 END' for t in SCAN_TERMS)}]) + {' + '.join(TERM_COUNT(t, 'page_content') for t in SCAN_TERMS)} AS score FROM chunk WHERE page_content IS NOT NULL),
h AS (SELECT chunk_id, page_content, row_number() OVER (ORDER BY score DESC, chunk_id) - 1 AS pos FROM z WHERE score > 0 ORDER BY score DESC, chunk_id LIMIT 15),
v AS (SELECT pos, i, ids[i] AS vid FROM (SELECT pos, ids, unnest(range(1, len(ids) + 1)) AS i FROM (SELECT pos, regexp_extract_all(page_content, '{VERSE_ID}', 1) AS ids FROM h WHERE pos < 3))),
s AS (SELECT pos, {SECTIONS('vid')} AS section, min(i) AS i FROM v GROUP BY ALL),
l AS (SELECT {SECTIONS('vid')} AS section, regexp_extract(vid, '(\\d+)$', 1)::INT AS no, max_by(line, (chunk_id, n)) AS line FROM {CHUNK_LINES} WHERE vid <> '' GROUP BY ALL),
b AS (SELECT section, string_agg(line, chr(10) ORDER BY no) AS t FROM l GROUP BY section),
f AS (SELECT pos, left(string_agg('## ' || section || chr(10) || t, chr(10) || chr(10) ORDER BY i), 6000) AS full_text FROM s JOIN b USING (section) GROUP BY pos)
SELECT pos, coalesce(length(full_text) > length(page_content), false) AS expanded, CASE WHEN coalesce(length(full_text) > length(page_content), false) THEN full_text ELSE page_content END AS page_content FROM h LEFT JOIN f USING (pos)""",
    "kg_upsert": f"SELECT subject_key, relation, object_key, array_to_string(citations, '|') AS cites, trust, first_seq FROM {EDGES}",
    "kg_inverse": f"""WITH e AS (SELECT * FROM {EDGES}), b AS (SELECT subject_key, relation, object_key, trust, first_seq, 1 AS stated FROM e UNION ALL
SELECT object_key, CASE relation {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in INVERSES.items())} END, subject_key, trust, first_seq, 0 FROM e WHERE relation IN ({lst(INVERSES)}))
SELECT subject_key, relation, object_key, max_by(trust, (stated, trust, -first_seq)) AS trust, max(stated) AS stated FROM b GROUP BY subject_key, relation, object_key""",
    "kg_nodes": f"WITH e AS (SELECT * FROM {EDGES}) SELECT entity, sum(o)::BIGINT AS out_degree FROM (SELECT subject_key AS entity, 1 AS o FROM e UNION ALL SELECT object_key, 0 FROM e) GROUP BY entity",
    "kg_degree": f"SELECT subject_key, count(*) AS facts FROM {EDGES} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "kg_members": f"SELECT object_key AS dynasty, list_sort(list_distinct(list(subject_key))) AS members FROM {EDGES} WHERE relation = 'member_of_dynasty' GROUP BY 1",
    "kg_two_hop": f"""WITH RECURSIVE e AS (SELECT subject_key, relation, object_key FROM {EDGES}), st AS (SELECT DISTINCT {KEY.format('subject')} AS subject_key FROM kg_seed WHERE fact_id % 20 = 0 AND subject IS NOT NULL),
w AS (SELECT e.*, 1 AS hop FROM e JOIN st USING (subject_key) UNION SELECT e.*, hop + 1 FROM w JOIN e ON e.subject_key = w.object_key WHERE hop < 2)
SELECT subject_key, relation, object_key, min(hop) AS hop FROM w GROUP BY 1, 2, 3""",
    "kg_context": f"""SELECT subject_key, relation, object_key, '  • ' || subject || ' —[' || relation || ']→ ' || object || CASE WHEN len(citations) > 0 THEN '  [' || array_to_string(citations, ', ') || ']' ELSE '' END
|| CASE trust WHEN 3 THEN ' ✓traditional' WHEN 2 THEN ' ⚑legend(itihāsa)' ELSE '' END AS line FROM {EDGES}""",
    "kg_digraph": f"SELECT subject_key, object_key, max_by(relation, (first_seq, relation)) AS relation FROM {EDGES} GROUP BY 1, 2",
    "kg_rejected": f"SELECT relation, count(*) AS facts FROM kg_seed WHERE relation NOT IN ({lst(RELATIONS)}) GROUP BY 1",
    "kg_fk_walk": """WITH u AS (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'), c AS (SELECT DISTINCT o_custkey AS k FROM u), n AS (SELECT DISTINCT c_nationkey AS k FROM customer JOIN c ON c_custkey = k)
SELECT 'placed_by' AS relation, 1 AS hop, count(*) AS edges FROM u UNION ALL SELECT 'in_nation', 2, count(*) FROM customer JOIN c ON c_custkey = k UNION ALL SELECT 'in_region', 3, count(*) FROM nation JOIN n ON n_nationkey = k""",
    "metadata_override": """WITH c AS (SELECT filename, max(citation) AS summary, min(source) AS first_source FROM documents WHERE filename IS NOT NULL GROUP BY 1)
SELECT coalesce(c.filename, b.filename) AS filename, title, coalesce(c.summary, b.summary) AS summary, source_url, first_source FROM corpus_metadata b FULL JOIN c ON b.filename = c.filename""",
    "variant_index": f"SELECT * FROM {VARIANT_INDEX}",
    "canonical_names": f"SELECT coalesce(canonical, word) AS canonical, count(DISTINCT fact_id) AS facts FROM {WORDS} LEFT JOIN {VARIANT_INDEX} ON word = variant GROUP BY 1",
    "noun_variants": f"SELECT canonical, list_sort(list_distinct(list(f))) AS forms FROM {VARIANTS} GROUP BY 1",
    "noun_context": "SELECT canonical, category, role, context, sources FROM (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY list_position(['given_name', 'place', 'tribe', 'deity'], category)) AS r FROM proper_noun) WHERE r = 1",
    "source_forms": f"SELECT v.canonical, list_sort(list_distinct(list(f))) AS forms FROM {VARIANTS} v WHERE (canonical, category) IN (SELECT (canonical, category) FROM proper_noun WHERE list_contains(sources, 'v01')) GROUP BY 1",
    "source_names": """SELECT veda, CASE len(n) WHEN 0 THEN 'the corpus' WHEN 1 THEN n[1] WHEN 2 THEN n[1] || ' and ' || n[2] ELSE array_to_string(n[:-2], ', ') || ', and ' || n[-1] END AS sources
FROM (SELECT metadata.veda AS veda, coalesce(list_sort(list_distinct(list(metadata.title) FILTER (metadata.title IS NOT NULL))), []) AS n FROM chunk GROUP BY 1)""",
    "latest_lines": f"SELECT * FROM {LINES}",
    "verse_parse": f"SELECT * FROM {VERSES}",
    "ingest_counts": f"SELECT file, count(*) AS verses, count(DISTINCT (book, hymn)) AS hymns, count(DISTINCT book) AS books, min(line_no) AS first_line, max(line_no) AS last_line, count(*) FILTER (verse = 1) AS opening_verses FROM {VERSES} GROUP BY 1",
    "passage_build": f"SELECT file, book || '.' || hymn AS passage, count(*) AS n_verses, string_agg(text, chr(10) ORDER BY verse, line_no, text) AS text FROM {VERSES} GROUP BY 1, 2",
    "carry_forward": f"SELECT file, line_no, last_value(h IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no) AS section FROM {HEADED}",
    "carry_levels": f"""SELECT file, line_no, book, last_value(h IGNORE NULLS) OVER (PARTITION BY file, g ORDER BY line_no) AS hymn FROM (
SELECT *, count(b) OVER (PARTITION BY file ORDER BY line_no) AS g, last_value(b IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no) AS book FROM {HEADED})""",
    "run_group": """SELECT user_id, run, event_type, count(*) AS events, min(event_id) AS first_event FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (
SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type OR row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 THEN 1 ELSE 0 END AS c FROM events)) GROUP BY 1, 2, 3""",
    "reset_counter": f"""SELECT file, line_no, book, hymn, sum(c) OVER (PARTITION BY file, book ORDER BY line_no)::BIGINT AS hymn_no FROM (SELECT *, CASE WHEN lag(hymn) OVER (PARTITION BY file, book ORDER BY line_no) IS DISTINCT FROM hymn THEN 1 ELSE 0 END AS c FROM {VERSES})""",
    "closed_groups": f"""SELECT file, line_no, coalesce(sum(CASE WHEN regexp_matches(text, '{MARKER}') THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS grp FROM {LINES} WHERE text IS NOT NULL AND trim(text) <> ''""",
    "line_spans": f"""WITH l AS (SELECT * FROM {HEADED}), m AS (SELECT file, max(line_no) + 1 AS e FROM l GROUP BY 1)
SELECT file, h, line_no, coalesce(lead(line_no) OVER (PARTITION BY file ORDER BY line_no), e) AS span_end FROM l JOIN m USING (file) WHERE h IS NOT NULL""",
    "file_dedup": f"""WITH t AS (SELECT file, string_agg(text, chr(10) ORDER BY line_no) AS t, count(text) AS lines FROM {LINES} WHERE text IS NOT NULL GROUP BY 1)
SELECT file, min(file) OVER (PARTITION BY t) AS first_file, lines FROM t""",
    "section_sink": f"""SELECT file, line_no // 50000 AS block, string_agg(CASE WHEN k IS DISTINCT FROM pk THEN chr(10) || '## ' || k || chr(10) || chr(10) ELSE '' END || text || chr(10), '' ORDER BY line_no) AS text FROM (
SELECT *, lag(k) OVER (PARTITION BY file ORDER BY line_no) AS pk FROM (SELECT *, book || '.' || hymn AS k FROM {VERSES})) GROUP BY 1, 2""",
    "book_headers": r"SELECT doc_id, coalesce(regexp_extract(text, '#\s+Book\s+([IVXLC]+)\.', 1)) AS book, regexp_extract(text, '##\s+Canto\s+([IVXLC]+)\.', 1) AS canto, regexp_extract(text, '(?m)^\s*(\d+)\.\s+', 1) AS section FROM documents",
    "script_ratio": doc(f"CASE WHEN length(text) = 0 THEN 0.0 ELSE round((length(left(text, 1000)) - length(regexp_replace(left(text, 1000), '{DEVANAGARI}', '', 'g'))) / length(left(text, 1000)), 6) END"),
    "script_flags": doc(f"concat_ws(',', regexp_matches(text, '{DEVANAGARI}')::VARCHAR, regexp_matches(lower(text), '[{IAST_LETTERS}]')::VARCHAR, (NOT regexp_matches(text, '{DEVANAGARI}') AND NOT regexp_matches(lower(text), '[{IAST_LETTERS}]'))::VARCHAR)"),
    "proper_nouns": f"""WITH w AS (SELECT fact_id, list_filter(regexp_split_to_array(subject, '{WS}+'), lambda x: x <> '')[2:] AS w FROM kg_seed WHERE subject IS NOT NULL),
b AS (SELECT fact_id, list_filter(list_transform(w, lambda x: regexp_replace(x, '[^\\p{{L}}\\p{{N}}_]', '', 'g')), lambda x: length(x) >= 3 AND regexp_matches(x, '^\\p{{Lu}}') AND NOT list_contains([{lst(NOT_NAMES)}], x) AND x <> upper(x)) AS w FROM w)
SELECT fact_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), '|') AS value FROM b""",
    "stem_tokens": fact(f"array_to_string(list_transform(list_filter(regexp_split_to_array(subject, '[\\s\\x{{0B}}।॥\\-,.;:!?]+'), lambda x: x <> ''), lambda x: {STEM}), ' ')"),
    "search_keys": fact(SEARCH_KEY.format("subject")),
    "sandhi_keys": f"""SELECT fact_id, pos, array_to_string(list_filter([k, CASE WHEN starts_with(k, 'i') AND length(k) > 4 THEN 'e' || k[2:] END, CASE WHEN starts_with(k, 'u') AND length(k) > 4 THEN 'o' || k[2:] END,
CASE WHEN starts_with(k, 'a') AND length(k) > 5 THEN k[2:] END], lambda x: x IS NOT NULL), '|') AS value FROM (SELECT fact_id, pos, {_sk} AS k FROM {WORDS})""",
    "romanisations": f"""SELECT fact_id, pos, array_to_string(CASE WHEN length(a[1]) < 4 THEN a[:1] ELSE list_filter(a, lambda x, i: list_position(a, x) = i) END, '|') AS value FROM (
SELECT fact_id, pos, [{_rom}, {_va}, {_vb}, replace({_vb}, 'ri', 'ṛ'), replace({_rom}, 'sh', 'ṣ')] AS a FROM {WORDS})""",
    "plain_latin": fact(f"translate(subject, '{PLAIN_FROM}', '{PLAIN_TO}')"),
    "dictionary_keys": fact("trim(lower(regexp_replace(regexp_replace(subject, '[/\\\\-]', '', 'g'), '[।॥.,;:!?]', '', 'g')), ' ')"),
    "bare_devanagari": doc(r"regexp_replace(text, '[\x{0900}-\x{0903}\x{093C}-\x{094D}\x{0951}-\x{0954}]', '', 'g')"),
    "key_terms": doc(
        r"array_to_string(list_filter(regexp_extract_all(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '\([^)]+\)', '', 'g'), '[\p{L}\p{M}\p{N}_]+'), "
        "lambda x: regexp_matches(x, '^[a-zA-Z]{5,}$') AND NOT list_contains(['which', 'there', 'their', 'about', 'other', 'being', 'having', 'called', 'often'], lower(x)))[:5], '|')"
    ),
    "url_fragments": doc("regexp_replace(translate(lower(text), ' .', '--'), '[^a-z0-9-]', '', 'g')"),
    "json_props": "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events",
    "visit_counts": "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS visits FROM events GROUP BY 1, 2",
    "pinned_turns": """SELECT event_id, last_value(p IGNORE NULLS) OVER (PARTITION BY user_id, u ORDER BY ts, event_id) AS pinned FROM (
SELECT *, CASE WHEN event_type = 'purchase' THEN event_id END AS p, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS u FROM events)""",
    "rows_by_source": "SELECT source, count(*) AS rows FROM documents GROUP BY 1",
}
