from pyspark.sql import functions as F

from shabdagrid.functions import citations as C
from shabdagrid.functions import text as T
from shabdagrid.functions import translit


def col(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["v"] for r in df.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_script_predicates(spark):
    assert col(spark, T.script_ratio, "", "कa", "x" * 2000, None) == [0.0, 0.5, 0.0, None]
    assert col(spark, T.is_english_query, "what is agni", "agnī", "अग्नि") == [True, False, False]


def test_words_split_at_every_white_space(spark):
    assert col(spark, T.words, " a b c\n", "", None) == [["a", "b", "c"], [], None]


def test_search_keys(spark):
    assert col(spark, T.search_key, "Candra", "Kṛṣṇa", "Viśvāmitraḥ", "chandra", "") == ["chandra", "krishna", "vishvamitra", "chhandra", ""]
    assert col(spark, T.sandhi_variants, "ikshvaku", "udaka", "agastya", "ila") == [["ikshvaku", "ekshvaku"], ["udaka", "odaka"], ["agastya", "gastya"], ["ila"]]
    assert col(spark, T.romanisation_variants, "Krishna", "abc") == [["krishna", "kriśna", "kṛśna", "kriṣna"], ["abc"]]


def test_stems(spark):
    assert col(spark, lambda c: T.stems(T.fallback_tokens(c)), "Sudasasya Sudasam, am Agnena rama") == [["Sudas", "Sudas", "am", "Agn", "ram"]]


def test_proper_nouns(spark):
    q = "Who was Sudas in the Battle of Sudas, Vasiṣṭha's RIVER king Hymn Yu?"
    assert col(spark, T.proper_nouns, q, "Agni", "") == [["Sudas", "Vasiṣṭhas"], [], []]


def test_keyword_query(spark):
    got = col(spark, T.keyword_query, "What is the Sūdaḥ? [01-001]", "अग्नि कः?", "is the")
    assert got[0].split() == ["Sudah", "[01-001]"] and got[1] == "अग्नि कः?" and got[2] == "is the"


def test_speech_keeps_accents(spark):
    s = "॥ RV 1.1.1 ॥ अ॒ग्निमी॑ळे पु॒रोहि॑तं ॥ 1 ॥"
    (out,) = col(spark, T.clean_for_speech, s)
    assert out == "अ॒ग्निमी॑ळे पु॒रोहि॑तं" and col(spark, T.accent_signature, s) == col(spark, T.accent_signature, out)


def test_transliteration_round_trip(spark):
    pairs = {"agniḥ": "अग्निः", "sarasvatī": "सरस्वती", "kṛṣṇa": "कृष्ण", "aitareya": "ऐतरेय", "vāk": "वाक्", "indrāgnī": "इन्द्राग्नी"}
    assert col(spark, translit.to_devanagari, *pairs, None, "") == [*pairs.values(), None, ""]
    assert col(spark, translit.to_iast, *pairs.values()) == list(pairs)
    v = translit.query_variants("सरस्वती")
    assert {"सरस्वती", "sarasvatī", "Sarasvatī", "sarasvati", "Sarasvati"} <= set(v) and v == sorted(v, key=lambda x: (-len(x), x))


def test_citations(spark):
    texts = ["see RV 1.1.1 there", "[01-001] HYMN I", "VSK 13.3", "PBr. IV.2.1", "SB 1.1.1.4", "# Book II.\n## Canto IV. Title.\n[007]", "Sukta 4", "# Hymn 3: Dawn", "Book 4", "nothing", ""]
    want = ["RV 1.1.1", "RV 1.1", "YV 13.3", "PB 4.2.1", "SB 1.1.1.4", "Ramayana Book 2, Canto 4, Verse 7", "Unknown Reference", "Hymn 3 (Dawn)", "Book 4", None, None]
    assert col(spark, C.verse_reference, *texts) == want
    assert col(spark, C.roman_to_int, "IV", "XXI", "MCMXC", "", "A") == [4, 21, 1990, 0, None]
    assert col(spark, C.url_fragment, "RV 1.1.1") == ["rv-1-1-1"]
    assert col(spark, C.section_title, "[Names (G): Agni, Soma]", "# Hymn 1: Dawn", "x") == ["Agni", "Dawn", None]
    assert col(spark, lambda c: C.citation_label(c, F.lit(None).cast("string"), F.lit(3)), "RV 1.1", "plain") == ["RV 1.1", "Passage 3"]


def test_question_modes(spark):
    assert col(spark, T.question_mode, "compare the earlier and later layers", "list all verses on gold", "who is Agni") == ["diachronic", "concordance", "plain"]


def test_cleaners(spark):
    from shabdagrid.functions import cleaners as K

    assert col(spark, K.edition_to_iast, "bʰ r̥ m̐") == ["bh ṛ ṃ"]
    assert col(spark, K.strip_variants, "a {F x} b}") == ["a  b"]
    assert col(spark, K.strip_edition_marks, "'po '2 a\\b x=y  z", "//") == ["po a b xy z", ""]
    assert col(spark, lambda c: K.edition_to_devanagari(c, accents=True), "agníḥ pūrve", None) == ["अग्निः पूर्वे", None]


def test_question_predicates(spark):
    from shabdagrid.functions import questions as Q

    assert col(spark, Q.query_type, "How do I say fire", "sandhi rules", "who fought", None) == ["construction", "grammar", "factual", "factual"]
    assert col(spark, Q.is_refusal, "I do not have enough information", "yes") == [True, False]
    assert col(spark, lambda c: Q.keyword_expansion(c, [(["river"], ["A", "B"]), (["tribe"], ["B", "C"])]), "river tribe", "x") == [["A", "B", "C"], []]
    assert col(spark, Q.model_terms, "agni, sōma!;  -vāc-\n" + "x" * 40) == [["agni", "sma", "vāc"]]
    assert col(spark, Q.first_object, 'text {"a": 1} more', "none") == ['{"a": 1}', None]


def test_query_terms(spark):
    from shabdagrid.operators import expand

    gaz = lambda *rows: spark.createDataFrame(list(rows), "key string, tokens array<string>")
    lex = spark.createDataFrame([("primary", "indra", ["इन्द्र"])], "kind string, key string, tokens array<string>")
    q = spark.createDataFrame([(1, "war of Indra and अग्नि the Sudas Parikshit"), (2, "")], "id int, q string")
    got = {r["id"]: r["terms"] for r in expand.query_terms(q, "id", "q", gaz(("war", ["युद्ध"])), gaz(("sudas", ["सुदास"])), lex, ["and", "the"]).collect()}
    assert got[1][:4] == ["युद्ध", "इन्द्र", "अग्नि", "सुदास"] and len(got[1]) > 4 and 2 not in got
