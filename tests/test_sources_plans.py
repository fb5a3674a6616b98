import json

import pytest
from pyspark.sql import functions as F

from shabdagrid.plans import agent, editions, ingest
from shabdagrid.sources import files, graph
from shabdagrid.streaming import turns


def test_folder_scan(spark, tmp_path):
    def put(path, text):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, encoding="utf-8")

    meta = lambda n: json.dumps({"title": n, "author": ["a"], "filename": n, "mandala": None})
    put("r01/r01_metadata.json", meta("r01"))
    put("r01/r01.md", "one")
    put("r01/r01.txt", "other")
    put("sb/sb_metadata.json", meta("sb"))
    put("sb/sb_01.md", "b1")
    put("sb/sb_02.txt", "b2")
    put("x/x.md", "no metadata")
    put("y/y_metadata.json", "{broken")
    d = {r["content"]: (r["filename"], r["book"]) for r in files.load_documents(spark, str(tmp_path)).collect()}
    assert d == {"one": ("r01", None), "b1": ("sb", 1), "b2": ("sb", 2)}
    assert sorted(r[0].rsplit("/", 1)[1] for r in files.unpaired_texts(spark, str(tmp_path)).collect()) == ["x.md"]
    alone = {r["content"] for r in files.load_documents(spark, str(tmp_path), one_level=True).collect()}
    assert alone == {"one"}
    titles = spark.createDataFrame([("sb_01", "First book")], "base string, title string")
    assert {r["base"]: r["title"] for r in files.load_documents(spark, str(tmp_path), titles=titles).where("book is not null").collect()} == {"sb_01": "First book", "sb_02": "sb"}


def test_pages_and_json(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.htm").write_bytes("agniḥ".encode())
    (tmp_path / "p" / "b.htm").write_bytes("caf\xe9".encode("latin-1"))
    assert sorted(r["text"] for r in files.read_pages(spark, str(tmp_path / "p")).collect()) == ["agniḥ", "café"]
    seed = {"facts": [{"subject": "A", "relation": "fought", "object": "B", "citation": "c"}, {"subject": "A", "relation": "fought", "object": "C", "citation": "d", "provenance": "itihasa"}]}
    (tmp_path / "seed.json").write_text(json.dumps(seed))
    assert [r["provenance"] for r in files.seed_facts(spark, str(tmp_path / "seed.json")).orderBy("seq").collect()] == ["authoritative", "itihasa"]
    assert files.read_json_with_fallback(spark, [str(tmp_path / "no.json")], "a int").count() == 0
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "1.json").write_text('[{"k":"a","v":1},{"k":"b","v":1}]')
    (tmp_path / "j" / "2.json").write_text('[{"k":"a","v":2}]')
    got = {r["k"]: r["v"] for r in files.read_latest_by_key(spark, str(tmp_path / "j" / "*.json"), "k string, v int", "k").collect()}
    assert got == {"a": 2, "b": 1}


def test_replace_partition_and_embed(spark, tmp_path):
    p = str(tmp_path / "t")
    files.replace_partition(spark.createDataFrame([("a", 1), ("b", 2)], "filename string, v int"), p)
    files.replace_partition(spark.createDataFrame([("a", 9)], "filename string, v int"), p)
    assert sorted((r["filename"], r["v"]) for r in spark.read.parquet(p).collect()) == [("a", 9), ("b", 2)]
    e = files.embed(spark.createDataFrame([(1, "ab"), (2, None)], "id int, t string"), "t", lambda ts: [[float(len(t))] for t in ts])
    assert {r["id"]: r["embedding"] for r in e.collect()} == {1: [2.0], 2: [0.0]}
    x = spark.createDataFrame([("q", "a", ["RV 1.1"])], "q string, a string, c array<string>")
    assert files.export_answer(x, "q", "a", "c").first()["text"].endswith("- RV 1.1\n")


def test_ingest_pipeline(spark, data, tmp_path):
    out = ingest.build(spark.read.parquet(f"{data}/corpus_line.parquet"), str(tmp_path / "corpus"))
    assert set(out) == {"verses", "passages", "chunks", "postings", "lexicon"} and all(t.count() for t in out.values())
    assert out["verses"].groupBy("file", "line_no").count().where("count > 1").count() == 0


def test_latest_line_and_marker_spellings(spark):
    rows = [("f", 1, "a ॥ 1.1.1 ॥", "2024-01-01"), ("f", 1, "b ।। 1.1.1 ।।", "2024-02-01"), ("f", 2, "c || KP 1.1.2 ||", "2024-01-01"), ("f", 3, None, None), ("f", 4, "no marker", "2024-01-01")]
    df = spark.createDataFrame(rows, "file string, line_no int, text string, loaded_at string").withColumn("loaded_at", F.to_timestamp("loaded_at"))
    got = [tuple(r)[2:] for r in ingest.verses(ingest.current_lines(df)).orderBy("line_no").collect()]
    assert got == [("", 1, 1, 1, "b"), ("KP", 1, 1, 2, "c")]


def test_agent_machine(spark):
    seen = []
    model = lambda p: seen.append(p) or f"draft {len(seen)}"
    tools = {"dictionary": lambda w: ["agni"], "grammar": lambda t, c: f"{t}/{c}", "corpus": lambda q: [("RV 1.1", "x" * 900)], "expand": lambda q: ["नदी"]}
    s = agent.run("how do i say fire in sanskrit", tools, model, evaluate=lambda p: "2")
    assert (s.query_type, s.english_words, s.translations, s.grammar) == ("construction", ["fire"], {"fire": ["agni"]}, [("fire", "agni/declension")])
    assert s.messages[1:] == ["dictionary", "grammar", "corpus"] and s.refinements == 0 and agent.citations(s) == ["RV 1.1"]
    assert "x" * 501 not in seen[0] and "agni/declension" in seen[0]
    s = agent.run("where is the river", tools, model, facts="FACTS", evaluate=lambda p: "2 of 10", refinements=2)
    assert s.query_type == "factual" and s.refinements == 2 and s.score == 2 and "FACTS" in seen[-1]
    s = agent.run("where is it", tools, lambda p: "I could not find relevant information.", evaluate=lambda p: "0")
    assert s.refinements == 0 and s.score == -1
    assert agent.plan("explain the declension", pinned="v").query_type == "factual" and agent.plan("explain x").next_action == "grammar"
    assert agent.corpus_examples(lambda q: [("a", q)] * 7, "agni", "sentence").count("\n\n") == 4
    assert agent.corpus_examples(lambda q: [], "agni") == "No relevant passages found in corpus."


def test_shared_settings_and_rate(monkeypatch):
    monkeypatch.setenv("SG_K", "17")
    monkeypatch.setenv("SG_BAD", "x")
    assert agent.setting("SG_K", 3, cast=int) == 17 and agent.setting("SG_BAD", 3, cast=int) == 3
    assert agent.setting("SG_NONE", True, {"SG_NONE": "off"}, bool) is False and agent.setting("SG_ABSENT", 5) == 5
    assert agent.shared("one", lambda: [1]) is agent.shared("one", lambda: [2])
    import time

    began, slow = time.monotonic(), agent.rate_limited(lambda p: p, 0.05)
    assert [slow("a"), slow("b"), slow("c")] == ["a", "b", "c"] and time.monotonic() - began >= 0.1


def test_graph_store(spark, tmp_path):
    kind = "subject string, relation string, object string, citation string, note string, provenance string, seq long"
    f = spark.createDataFrame([("Agni", "has_son", "X", "c1", None, "inferred", 1), ("A", "fought", "B", None, "n", None, 2), (None, "fought", "B", None, None, None, 3)], kind)
    path = str(tmp_path / "g")
    assert graph.load(spark, path).count() == 0 and graph.load_or(spark, path, f).count() == 3
    assert graph.save(f, path, str(tmp_path / "mirror")) == 3 and graph.load(spark, path).count() == 2
    assert spark.read.json(str(tmp_path / "mirror")).count() == 3
    new = spark.createDataFrame([("agni", "has_son", "x", None, "later", "authoritative", 0), ("C", "fought", "D", None, None, None, 1)], kind)
    graph.save(graph.upsert(graph.load(spark, path), new), path)
    got = {r["subject"]: (r["citation"], r["note"], r["provenance"]) for r in graph.load_or(spark, path, f.limit(0)).collect()}
    assert got == {"Agni": ("c1", "later", "authoritative"), "A": (None, "n", None), "C": (None, None, None)}
    graph.save(graph.delete(graph.load(spark, path), new.where("subject = 'C'")), path)
    assert graph.load(spark, path).count() == 2
    e = spark.createDataFrame([("agni", "Agni", [("has_son", "X", "inferred"), ("epithet", None, None)])], "key string, display_name string, relations array<struct<relation:string,object:string,provenance:string>>")
    assert graph.migrate(e, str(tmp_path / "m")) == 1 and graph.load(spark, str(tmp_path / "m")).first()["provenance"] == "inferred"


def test_rewrite_index_and_fallback(spark, tmp_path):
    p = str(tmp_path / "t")
    files.rewrite_with_backup(spark.range(3), p)
    files.rewrite_with_backup(spark.range(5), p)
    assert spark.read.parquet(p).count() == 5 and spark.read.parquet(p + ".bak").count() == 3
    (tmp_path / "idx").mkdir()
    (tmp_path / "idx" / "rv_2.txt").write_text("hymn.verses\n1.5.A.B.C")
    assert [tuple(r) for r in files.read_hymn_index(spark, str(tmp_path / "idx")).orderBy("line_no").collect()] == [(2, 0, "hymn.verses"), (2, 1, "1.5.A.B.C")]
    hymns, whole = editions.hymn_index(files.read_hymn_index(spark, str(tmp_path / "idx")))
    assert hymns.count() == 1 and not whole
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "full.json").write_text('{"a": 1}')
    got = files.read_json_with_fallback(spark, [str(tmp_path / n) for n in ("none.json", "empty.json", "full.json")], "a int").collect()
    assert [r["a"] for r in got] == [1]
    files.write_records(spark.createDataFrame([("x", "said")], "who string, what string"), str(tmp_path / "debate"))
    assert spark.read.json(str(tmp_path / "debate")).first()["what"] == "said"
    a = files.ensure_table(spark, str(tmp_path / "e"), lambda: spark.range(2))
    assert a.count() == 2 and files.ensure_table(spark, str(tmp_path / "e"), lambda: spark.range(9)).count() == 2
    assert files.metadata_rows(spark, [editions.metadata(editions.EDITIONS["RV"], title="R")]).first()["title"] == "R"
    c = spark.createDataFrame([("a", 1), ("b", 2), ("c", 6), ("d", 7)], "file string, n int")
    assert [r["file"] for r in files.contiguous_files(c, "n").orderBy("n").collect()] == ["a", "b"]
    (tmp_path / "k.json").write_text('{"lookup": {"agni": "p1"}}')
    assert [tuple(r) for r in files.read_keyed_json(spark, str(tmp_path / "k.json"), "lookup", "string").collect()] == [("agni", "p1")]


def test_edition_ingest(spark, tmp_path):
    from shabdagrid.plans.more_queries import _landed

    for name in ("RV", "PB"):
        out = editions.ingest(editions.EDITIONS[name], _landed(spark, name), str(tmp_path))
    assert {r["filename"] for r in spark.read.parquet(f"{tmp_path}/chunks").collect()} == {"rv", "pb"}
    before = out["chunks"].count()
    assert out["verses"].count() == 3 and out["postings"].count() > 0 and out["lexicon"].count() > 0
    again = editions.ingest(editions.EDITIONS["PB"], _landed(spark, "PB"), str(tmp_path))
    assert again["chunks"].count() == before
    checks = editions.spot_checks(again["verses"], {"1.1.1": "महन्", "9.9.9": "x"}).collect()
    assert {r["address"]: r["found"] for r in checks} == {"1.1.1": True, "9.9.9": False}
    with pytest.raises(ValueError):
        editions.ingest(editions.EDITIONS["PB"], _landed(spark, "PB"), str(tmp_path), least=1000)
    v = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x"), ("b", 2, "y"), ("c", 1, "z")], "file string, pos int, text string")
    pages = spark.createDataFrame([("a", 1), ("b", 2), ("c", 9)], "file string, page int")
    assert {r["file"] for r in editions.unrepeated_pages(pages, v).collect()} == {"a"}
    gloss = spark.createDataFrame([(7, 13, 1, "7.13.1", "t")], "chapter int, adhyaya int, sentence int, address string, text string")
    assert editions.marked_lines(editions.EDITIONS["AB"], gloss).first()["line"].endswith("solar dynasty]")


def test_stream_equals_batch(spark, data, tmp_path):
    src = tmp_path / "in"
    ev = spark.read.parquet(f"{data}/events.parquet")
    ev.write.parquet(str(src))
    stream = spark.readStream.schema(ev.schema).parquet(str(src))
    q = turns.run_visit_stream(stream, "ts", "event_type", str(tmp_path / "out"), str(tmp_path / "ck"), late="0 seconds")
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("day", "event_type", "visits").collect()}
    want = {tuple(r) for r in turns.visit_counts(ev, "ts", "event_type").collect()}
    last = max(d for d, _, _ in want)
    assert got == {w for w in want if w[0] < last} or got == want


def test_pins(spark):
    rows = [(1, None, False), (2, "a", False), (3, None, False), (4, None, True), (5, None, False), (6, "b", True)]
    df = spark.createDataFrame(rows, "n int, p string, u boolean")
    got = [r["pinned"] for r in turns.pinned(df, [], ["n"], F.col("p"), F.col("u")).orderBy("n").collect()]
    assert got == [None, "a", "a", None, None, "b"]
