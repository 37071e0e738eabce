import hashlib
import os
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import chunking, evaluation, extraction, graph, resolve, search
from weftline.plans import runtime
from weftline.plans.ask import AskOptions, Inputs, cached_answers, compare, merged_searches, prompts, retrieve, rewritten, routed, stage_options
from weftline.sources import files
from weftline.streaming import ingest


def test_fixed_chunks_meet_and_recursive_spans_map_back(spark):
    text = "\n\n".join(f"Paragraph {i}. " + "word " * 60 for i in range(40))
    d = spark.createDataFrame([("a", text), ("b", ""), ("c", None), ("d", "   ")], "id string, text string")
    fixed = chunking.fixed_chunks(d).orderBy("ordinal").collect()
    assert all(x.end_char == y.start_char for x, y in zip(fixed, fixed[1:])) and {r.id for r in fixed} == {"a"}
    rec = chunking.recursive_chunks(d).orderBy("ordinal").collect()
    assert all(text[r.start_char : r.end_char] == r.text for r in rec) and any(y.start_char < x.end_char for x, y in zip(rec, rec[1:]))


def test_sections_take_the_waiting_front_matter(spark):
    lines = ["intro", "docType: title-record", "year: 2015", "Fantastic Four (2015)", "body one", "year: null", "subject: X", "Next Part", "body two", "studio: lost"]
    rows = [("d", i, 1, t, 20.0 if t in ("Fantastic Four (2015)", "Next Part") else 10.0, False) for i, t in enumerate(lines)]
    out = chunking.sections(spark.createDataFrame(rows, "doc_id string, n int, page int, text string, font_size double, bold boolean")).orderBy("ordinal").collect()
    assert [r.heading for r in out] == ["Preamble", "Fantastic Four (2015)", "Next Part"]
    assert (out[0].year, out[1].year, out[1].doctype, out[2].year, out[2].subject, out[2].studio) == (None, 2015, "title-record", None, "X", None)
    assert out[1].text == "Fantastic Four (2015)\nbody one"


def test_page_furniture(spark):
    rows = [("d", p, t, y) for p in range(1, 6) for t, y in ((f"Page {p}", 0.95), ("Studio note", 0.5), (f"Text {p}", 0.4))]
    lines = spark.createDataFrame(rows, "doc_id string, page int, text string, relative_y double")
    assert {r.shape for r in chunking.running_lines(lines).collect()} == {"Page #"}
    assert chunking.without_running_lines(lines).count() == 10
    assert chunking.rejoined(["a photo-", "graph of", "Paris-", "Lyon"]) == ["a photograph", "of", "Paris-", "Lyon"]
    assert chunking.grouped_lines([(100, 10, "b", 12, True), (101, 0, "a", 12, True), (50, 0, "c", 9, False)]) == [("a b", 12.0, True), ("c", 9.0, False)]
    pages = spark.createDataFrame([("d", 1, "ab"), ("d", 2, "cde")], "doc_id string, page int, text string")
    assert [r.start_char for r in chunking.page_offsets(pages).orderBy("page").collect()] == [0, 4]
    assert chunking.joined_pages(pages).first().raw_text == "ab\n\ncde"
    assert chunking.scanned_documents(pages).count() == 1


def test_rank_fusion_and_figures(spark):
    docs = spark.createDataFrame([("a", "the film opened"), ("b", "takings of 3,571,150,070 in a week"), ("c", "a week of rain")], "id string, text string")
    q = spark.createDataFrame([(1, "Who made 3,571,150,070?")], "question_id int, question string")
    assert search.top_k(search.bm25(docs, q), 5).first().id == "b"
    v = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "question_id int, id string, rank int")
    k = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "question_id int, id string, rank int")
    got = search.top_k(search.fuse(v, k), 3).orderBy("rank").collect()
    assert [(r.id, r.arm) for r in got] == [("b", "both"), ("a", "vector"), ("c", "keyword")]


def test_many_queries_meet_every_vector(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 5 + 1), 1.0]) for i in range(50)] + [(99, [1.0])], "id int, vector array<double>")
    q = v.where("id < 3").withColumnRenamed("id", "question_id")
    few = {tuple(r) for r in search.vector_scores(v, q).collect()}
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 2)
    assert {tuple(r) for r in search.vector_scores(v, q, salts=4).collect()} == few and len(few) == 150


@pytest.mark.parametrize("most", [10_000, 1])
def test_best_vectors_with_ties_zeros_and_widths(spark, monkeypatch, most):
    monkeypatch.setattr(search, "BROADCAST_QUERIES", most)
    rows = [(f"v{i}", [1.0, float(i % 3)]) for i in range(40)] + [("zero", [0.0, 0.0]), ("null", None), ("wide", [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    held = spark.createDataFrame(rows, "id string, vector array<float>").repartition(3)
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, None), (4, [-1.0, 0.0])], "question_id int, vector array<double>")
    got = {}
    for r in search.vector_top(held, asked, 3, digits=6).orderBy("rank").collect():
        got.setdefault(r.question_id, []).append((r.id, r.score))
    assert got == {1: [("v0", 1.0), ("v12", 1.0), ("v15", 1.0)], 2: [("wide", 1.0)], 4: [("zero", 0.0), ("v11", -0.447214), ("v14", -0.447214)]}


def test_filters_follow_the_question(spark):
    s = spark.createDataFrame([("title-record", "Fantastic Four", 2005, None), ("title-record", "Fantastic Four", 2015, None), ("box-office-record", "Endgame", 2019, None)], "doctype string, subject string, year int, studio string")
    q = spark.createDataFrame([(1, "Who directed Fantastic Four (2015)?"), (2, "What was the box office of Endgame in 2005?")], "question_id int, question string")
    got = {r.question_id: r for r in search.inferred_filters(q, s).collect()}
    assert (got[1].year, got[1].subject, got[1].doctype) == (2015, "Fantastic Four", None)
    assert (got[2].year, got[2].doctype) == (None, "box-office-record")


def edges(spark, rows):
    full = [("d", s, p, o, 0.9, 1, False, ["c"]) for s, p, o in rows]
    return spark.createDataFrame(full, "doc_id string, subject string, predicate string, object string, confidence double, mentions bigint, derived boolean, chunk_ids array<string>")


GRAPH = [("ilse", "ACTED_IN", "thaw"), ("dara", "DIRECTED", "thaw"), ("dara", "DIRECTED", "vermilion"), ("piet", "ACTED_IN", "vermilion"), ("thaw", "SHOT_BY", "ana"), ("vermilion", "SHOT_BY", "ana"), ("thaw", "PRODUCED_BY", "meridian"), ("vermilion", "PRODUCED_BY", "meridian")]


def test_paths_and_collaborations(spark):
    e = edges(spark, GRAPH)
    kinds = [(k, "Film" if k in ("thaw", "vermilion") else "Studio" if k == "meridian" else "Person") for k in ("ilse", "dara", "piet", "ana", "thaw", "vermilion", "meridian", "loki")]
    n = spark.createDataFrame([("d", k, t, k.title(), None, 2) for k, t in kinds], "doc_id string, key string, type string, name string, year int, mentions int")
    roads = e.select(F.col("subject").alias("a"), F.col("object").alias("b"))
    assert [r.key for r in graph.shortest_path(roads, "ilse", "piet").orderBy("hop").collect()] == ["ilse", "thaw", "ana", "vermilion", "piet"]
    assert graph.shortest_path(roads, "ilse", "loki").count() == 0 and graph.shortest_path(roads, "ilse", "ilse").count() == 0
    pairs = {(r.a, r.b): r.shared for r in graph.collaborations(e, n).collect()}
    assert pairs["ana", "dara"] == 2 and pairs["ana", "ilse"] == 1 and ("ilse", "piet") not in pairs
    again = graph.derived_edges(graph.derived_edges(e, n), n)
    assert again.where("derived").count() == len(pairs)
    assert graph.works_by_studio(e, n).first().films == 2
    steps = spark.createDataFrame([([("Ilse", None, "ACTED_IN", True, "The Thaw", 2024, False), ("The Thaw", 2024, "ACTED_IN", False, "Piet", None, True)],)], "s array<struct<here:string,here_year:int,predicate:string,forward:boolean,there:string,there_year:int,here_is_work:boolean>>")
    assert steps.select(graph.narrative(F.col("s"))).first()[0] == "Ilse acted in The Thaw (2024), which starred Piet."
    assert graph.edge_evidence(e, spark.createDataFrame([("c", "t")], "id string, text string")).count() == 8


def test_proposals_are_turned_dropped_and_merged(spark):
    c = spark.createDataFrame([("c1", "The Thaw was shot by Ana. Dara directed The Thaw."), ("c2", "Dara directed The Thaw.")], "id string, text string")
    p = [("c1", "Ana", "Person", "SHOT_BY", "The Thaw", "Film", "shot by Ana", 1.7), ("c1", "M", "Studio", "PLAYED", "The Thaw", "Film", "x", 0.5), ("c1", "Dara", "Person", "->directed", "The Thaw", "Film", "never said", 0.7), ("c2", "Dara", "Person", "DIRECTED", "The Thaw", "Film", "Dara directed The Thaw", 0.95), ("c1", " ", "Person", "DIRECTED", "The Thaw", "Film", "x", 0.9), ("c1", "Zoe", "Person", "DIRECTED", "The Thaw", "Film", "none", None)]
    rows = spark.createDataFrame(p, "chunk_id string, subject string, subject_type string, predicate string, object string, object_type string, evidence string, confidence double")
    rules = spark.createDataFrame([("SHOT_BY", "Film", "Person"), ("DIRECTED", "Person", "Film")], "predicate string, from_type string, to_type string")
    g = extraction.graded_relations(rows, c, rules)
    assert sorted(r.status for r in g.collect()) == ["blank", "kept", "kept", "kept", "ungrounded", "unknown-predicate"]
    turned = g.where("flipped").first()
    assert (turned.subject, turned.object, turned.confidence) == ("The Thaw", "Ana", 1.0)
    m = extraction.merged_triples(g.where("status = 'kept'")).where("predicate = 'DIRECTED'").first()
    assert (m.mentions, m.confidence, m.chunk_ids) == (2, 0.95, ["c1", "c2"])
    assert extraction.metrics(g).first().kept == 3
    batched = extraction.verification_batches(extraction.merged_triples(g.where("status = 'kept'")))
    v = spark.createDataFrame([("c1", 0, 0, "partial"), ("c1", 0, 1, "UNSUPPORTED")], "chunk_id string, batch int, index int, verdict string")
    done = extraction.with_verdicts(batched, v).collect()
    assert len(done) == 1 and done[0].confidence == pytest.approx(0.95 * 0.7)


def test_resolution_is_greedy_and_keeps_types_apart():
    def e(key, norm, kind="Person", n=1, year=None, roles=(), ordinal=""):
        return {"key": key, "norm": norm, "type": kind, "mentions": n, "year": year, "work": None, "roles": list(roles), "ordinal": ordinal, "vector": None}

    films = resolve.clusters([e("1", "spider man", "Film", 3, 2002), e("2", "spider man 2", "Film", 2, 2004, ordinal="2"), e("3", "spider man 3", "Film", 1, 2007, ordinal="3")])
    assert len({c for _, c, _ in films}) == 3
    people = resolve.clusters([e("a", "katherine okonjo", n=7), e("b", "k. okonjo", n=2)])
    assert {c for _, c, _ in people} == {"a"}
    split = resolve.clusters([e("a", "j vance", n=7, roles=["DIRECTED"]), e("b", "james vance", n=2, roles=["ACTED_IN"])])
    assert ("b", "a", "flagged") in split and ("b", "b", "member") in split


def test_resolution_on_tables(spark):
    rows = [("d", "Person", "a", "Katherine Okonjo", "katherine okonjo", 7), ("d", "Person", "b", "K. Okonjo", "k. okonjo", 2), ("d", "Studio", "s", "K. Okonjo", "k. okonjo", 1)]
    d = spark.createDataFrame(rows, "scope string, type string, key string, name string, norm string, mentions int").selectExpr("*", "cast(null as int) as year", "cast(null as string) as work", "'' as ordinal", "cast(null as array<string>) as roles", "cast(null as array<double>) as vector")
    best = {r.cluster: r for r in resolve.canonical(d, resolve.resolve(d)).collect()}
    assert (best["a"].name, best["a"].aliases, best["a"].mentions) == ("Katherine Okonjo", ["K. Okonjo"], 9) and "s" in best


def test_citations(spark):
    answers = spark.createDataFrame([(1, "The Thaw was directed by Dara Okonjo [1]."), (2, "Penguins invaded the harbour town [1]."), (3, "Yes."), (4, " \n"), (5, None)], "answer_id int, answer string")
    ctx = spark.createDataFrame([(i, 1, "c", "The Thaw was directed by Dara Okonjo in 2024.") for i in range(1, 6)], "answer_id int, rank int, chunk_id string, text string")
    got = {r.answer_id: r.groundedness for r in evaluation.groundedness(answers, ctx).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 1.0, 4: 0.0, 5: 0.0}
    assert evaluation.groundedness(answers, ctx.limit(0)).where("groundedness = 0").count() == 5


def test_grading(spark):
    golden = spark.createDataFrame([("q1", "simple", ["Dara Okonjo"], None, None), ("q2", "ungrounded", None, None, None), ("q3", "path", None, ["ana"], None), ("q4", "simple", None, None, None), ("q5", "simple", [], ["Ana"], False)], "id string, type string, expected_contains array<string>, expected_path array<string>, expect_refusal boolean")
    no = "Not found in the provided documents."
    rows = [("q1", 1, "It was dara  okonjo.", None), ("q1", 0, "Nobody", None), ("q2", 1, no, None), ("q2", 0, no, None), ("q2", 2, "Ann", None), ("q3", 1, "x", ["Ilse", "Ana Lee"]), ("q3", 2, "Ana", []), ("q4", 1, "anything", None), ("q5", 1, "anything", ["Ana"])]
    r = spark.createDataFrame(rows, "question_id string, stage int, answer string, path array<string>")
    assert {(x.question_id, x.stage) for x in evaluation.graded(r, golden).where("pass").collect()} == {("q1", 1), ("q2", 1), ("q3", 1)}
    assert evaluation.golden_subset(golden, ["q1", "q9"]).count() == 1 and evaluation.golden_subset(golden).count() == 5


def test_recall_by_chunks_then_sections_then_any(spark):
    hits = spark.createDataFrame([("q1", "c1", "Chapter One: The Thaw", "x"), ("q2", "c2", "Two", "about Endgame"), ("q3", "c9", None, None)], "question_id string, chunk_id string, section string, text string")
    want = spark.createDataFrame([("q1", [], ["the thaw", "Endgame"]), ("q2", ["c2", "c3", "c4"], ["Two"]), ("q3", None, None), ("q4", [], []), ("q2b", [], ["endgame"])], "question_id string, expected_chunk_ids array<string>, expected_sections array<string>")
    got = {r.question_id: r.recall for r in evaluation.recall(hits, want).collect()}
    assert got == {"q1": 0.5, "q2": 0.333333, "q3": 1.0, "q4": 0.0, "q2b": 0.0}


def test_front_matter_blocks_start_empty(spark):
    texts = ["docType: film", "year: 2001", "studio: Old", "# One", "a", "subject: New", "year: soon", "# Two", "b", "# Three", "c", "year: 1999", "year: null", "# Four", "d", "docType: lost"]
    lines = spark.createDataFrame([("d", i, 1, t, 10.0, False) for i, t in enumerate(texts)], "doc_id string, n int, page int, text string, font_size double, bold boolean")
    got = [(r.heading, r.doctype, r.subject, r.year, r.studio) for r in chunking.sections(lines).orderBy("ordinal").collect()]
    assert got == [("One", "film", None, 2001, "Old"), ("Two", None, "New", None, None), ("Three", None, "New", None, None), ("Four", None, None, 1999, None)]


def test_evidence_is_repaired_over_levelled_text(spark):
    rows = [("It was “Ann\u00a0Lee’s” film. Bo too.", ["ann lee's"]), ("Ann met Bo. Ann Lee.", []), ("Ann met Bo.", [" "]), ("Ann met Bo.", [None]), ("Ann met Bo.\nBo left.", ["Bo"]), (" ", ["x"]), (None, ["x"]), ("Ann met Bo.", ["Cy"])]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, n array<string>").select(text.repaired_evidence(F.col("t"), F.col("n"))).collect()]
    assert got == ["It was “Ann\u00a0Lee’s” film.", None, None, None, "Bo left.", None, None, None]


REPLY = """{"entities": [{"name": "The Thaw", "type": "Film", "evidence": "The Thaw"}, {"name": "Dara Okonjo", "type": "Person", "evidence": "made up"}, {"name": "Loki", "type": "Character", "evidence": "Loki"},
{"name": "dara okonjo", "type": "Studio", "evidence": "Dara Okonjo"}, {"name": "Nobody", "type": "Person", "evidence": "none"}, {"name": "X", "type": "Dragon", "evidence": "The Thaw"}, {"name": " ", "type": "Person"}],
"relations": [{"subject": "DARA OKONJO", "predicate": "directed", "object": "the thaw", "evidence": "The Thaw", "confidence": 0.9, "properties": {"role": "lead"}}, {"subject": "Dara Okonjo", "predicate": "directed", "object": "Nobody"}, {"subject": "", "object": "x"}]}"""


def test_replies_become_entities_and_relations(spark):
    replies = spark.createDataFrame([("c", REPLY), ("gone", REPLY), ("c2", "no json"), ("c3", None)], "chunk_id string, json string")
    held = spark.createDataFrame([("c", "Dara Okonjo made The Thaw with Loki.", "Some Subject", 2024), ("c2", "x", None, None)], "id string, text string, subject string, year int")
    kinds = spark.createDataFrame([("Film",), ("Person",), ("Studio",), ("Character",)], "type string")
    e = extraction.graded_entities(replies, held, kinds)
    got = {(r.name, r.type): (r.status, r.key, r.evidence) for r in e.collect()}
    assert got["The Thaw", "Film"] == ("kept", "film:the-thaw:2024", "The Thaw") and got["Loki", "Character"] == ("kept", "character:loki:the-thaw", "Loki")
    assert got["Dara Okonjo", "Person"] == ("repaired", "person:dara-okonjo", "Dara Okonjo made The Thaw with Loki.")
    assert {k[0]: v[0] for k, v in got.items() if v[0] not in ("kept", "repaired")} == {"Nobody": "ungrounded", "X": "unknown-type", "": "blank"}
    rel = {(r.subject, r.object): (r.subject_type, r.object_key, r.endpoints) for r in extraction.proposed_relations(replies.where("chunk_id = 'c'"), e).collect()}
    assert rel == {("dara okonjo", "The Thaw"): ("Studio", "film:the-thaw:2024", True), ("dara okonjo", "Nobody"): ("Studio", None, False)}


def test_commits_can_be_repeated_and_maps_keep_the_first(spark):
    kinds = "doc_id string, subject string, predicate string, object string, confidence double, mentions bigint, evidence string, chunk_ids array<string>"
    old = spark.createDataFrame([("a", "x", "P", "y", 0.5, 9, "e", ["a#0"]), ("b", "x", "P", "y", 0.5, 1, "e", ["b#0"])], kinds)
    new = spark.createDataFrame([("a", "x", "P", "z", 0.7, 2, "long", ["a#1"]), ("a", "x", "P", "z", 0.9, 3, "e", ["a#0", "a#1"]), ("a", "x", "P", "w", 0.1, 1, None, None)], kinds)
    once = extraction.committed(new, old)
    want = {("b", "y", 0.5, 1, "e", ("b#0",)), ("a", "z", 0.9, 5, "long", ("a#0", "a#1")), ("a", "w", 0.1, 1, None, ())}
    for got in (once, extraction.committed(new, once)):
        assert {(r.doc_id, r.object, r.confidence, r.mentions, r.evidence, tuple(r.chunk_ids)) for r in got.collect()} == want
    maps = spark.createDataFrame([("x", "P", "y", "c2", {"a": "late", "b": "2"}), ("x", "P", "y", "c1", {"a": "early"}), ("x", "P", "z", "c1", None)], "subject string, predicate string, object string, chunk_id string, properties map<string,string>")
    assert [r.properties for r in extraction.merged_properties(maps).collect()] == [{"a": "early", "b": "2"}]


def test_presets_guesses_and_endpoints(spark):
    e = edges(spark, GRAPH)
    people = spark.createDataFrame([("d", "ilse", "Person", "Ilse", None), ("d", "dara", "Person", "Dara Okonjo", None), ("d", "meridian", "Studio", "Meridian", None), ("d", "thaw", "Film", "The Thaw", 2024), ("d", "vermilion", "Film", "Vermilion", 2024)], "doc_id string, key string, type string, name string, year int")
    assert graph.aggregate("studio-film-count", e, people).first().films == 2
    assert all(graph.aggregate(p, e, people).count() >= 0 for p in graph.PRESETS)
    with pytest.raises(ValueError):
        graph.aggregate("unknown", e, people)
    q = spark.createDataFrame([(1, "How is ILSE tied to Dara Okonjo, who won in 2004?"), (2, "Which franchise of 12004 or 1899?"), (3, "Who shot it?")], "question_id int, question string")
    assert {r.question_id: (r.from_key, r.to_key) for r in graph.endpoints(q, people).collect()} == {1: ("dara", "ilse"), 2: (None, None), 3: (None, None)}
    got = q.orderBy("question_id").select(text.preset_guess(F.col("question")), text.year_guess(F.col("question"))).collect()
    assert [tuple(r) for r in got] == [("award-tally-by-studio", 2004), ("multi-franchise-actors", None), ("director-cinematographer-pairs", None)]
    steps = graph.path_steps(graph.shortest_path(e.select(F.col("subject").alias("a"), F.col("object").alias("b")), "ilse", "dara"), e, people)
    assert graph.told_path(steps).first()[0] == "Ilse acted in The Thaw (2024), which was directed by Dara Okonjo."
    assert graph.told_path(steps.limit(0)).count() == 0 and graph.edge(e, "ilse", "ACTED_IN", "thaw").count() == 1
    assert graph.snapshot_nodes(e.where("subject = 'ilse'"), people).count() == 2
    id_ = spark.range(1).select(text.point_id(F.lit("dos#1")), text.filter_description(F.lit("a"), F.lit(2001), F.lit(None), F.lit(None), F.lit(None), F.lit("S"))).first()
    digest = hashlib.md5(b"dos#1").digest()
    assert id_[0] == str(uuid.UUID(bytes_le=digest)) and id_[1] == "docType=a, year=2001, studio=S"


def test_large_casts_are_dealt_to_blocks(spark, monkeypatch):
    e = spark.createDataFrame([("d", f"p{i:02d}", "ACTED_IN", f"w{j}") for i in range(12) for j in range(3) if (i + j) % 3], "doc_id string, subject string, predicate string, object string")
    n = spark.createDataFrame([("d", f"p{i:02d}", "Person", f"P{i}") for i in range(12)] + [("d", f"w{j}", "Film", f"W{j}") for j in range(3)], "doc_id string, key string, type string, name string")
    want = {tuple(r) for r in graph.collaborations(e, n).collect()}
    monkeypatch.setattr(graph, "CAST", 3)
    assert {tuple(r) for r in graph.collaborations(e, n).collect()} == want and len(want) > 30


def test_shared_credits_shuffle_no_meetings_and_count_each_work_once(spark, monkeypatch):
    rows = [(d, f"p{i}" if i else None, "DIRECTED", f"w{j}") for i in range(9) for j in range(7) if (i + j) % 3 for d in ("d", "e") if d == "d" or (i + j) % 2]
    rows += [(d, f"w{j}", "SHOT_BY", f"q{i}" if i else None) for i in range(8) for j in range(6) if (i * j) % 4 != 1 for d in ("d", "e", "f") if d == "d" or i % 2]
    rows += [(None, "p1", "DIRECTED", "w0"), (None, "w0", "SHOT_BY", "q9"), ("d", "p1", "DIRECTED", None), ("d", None, "SHOT_BY", "q9"), *rows[:5]]
    e = spark.createDataFrame([(*r, 0.9) for r in rows] + [("d", "p1", "DIRECTED", "w5", 0.1)], "doc_id string, subject string, predicate string, object string, confidence double")
    want = {}
    for d, who, _, work in (r for r in rows if r[2] == "DIRECTED" and r[0] and r[3]):
        for other in (r[3] for r in rows if r[2] == "SHOT_BY" and r[:2] == (d, work)):
            want.setdefault((who, other), set()).add(work)
    monkeypatch.setattr(graph, "MEETINGS", 5)
    monkeypatch.setattr(graph, "PAIRS", 3)
    got = graph.shared_credits(e, "DIRECTED", "SHOT_BY")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((*k, len(v))) for k, v in want.items())
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()  # the meetings themselves were shuffled before
    assert graph.shared_credits(e, "DIRECTED", "WON").count() == 0 and graph.shared_credits(e.limit(0), "DIRECTED", "SHOT_BY").count() == 0


def test_lines_of_pages(spark):
    words = spark.createDataFrame([("d", 1, 90.0, 10.0, "exam-", 10.0, True), ("d", 1, 91.0, 5.0, "An", 12.0, True), ("d", 1, 80.0, 5.0, "ple here", 10.0, None)], "doc_id string, page int, baseline double, left double, text string, font_size double, bold boolean")
    lines = chunking.lines_of_words(words)
    assert [(r.n, r.text, r.font_size, r.bold) for r in lines.orderBy("n").collect()] == [(0, "An exam-", 11.0, True), (1, "ple here", 10.0, False)]
    assert [r.text for r in chunking.rejoined_lines(lines).orderBy("n").collect()] == ["An example", "here"]
    rows = spark.createDataFrame([(i,) for i in range(1000)], "i int").repartition(7)
    assert sorted(r.i for r in chunking.spread(rows, 7, "i").collect()) == [i * 1000 // 7 for i in range(7)] and chunking.spread(rows.limit(5), 7, "i").count() == 5
    pages = spark.createDataFrame([("d", 1, "x" * 40), ("d", 2, "x" * 60), ("e", 1, None), ("e", 2, "x" * 30), ("e", 3, "x")], "doc_id string, page int, text string")
    assert {(r.doc_id, r.median_chars) for r in chunking.scanned_documents(pages).collect()} == {("e", 1)}


def test_stage_options_are_cumulative_and_clamped():
    seen = {stage_options(s) for s in range(12)}
    assert len(seen) == 12 and stage_options(5).rerank and not stage_options(4).rerank and stage_options(10).graph == "expand"
    assert AskOptions(top_k=99, candidate_k=1, max_hops=0).normal() == AskOptions(top_k=50, candidate_k=50, max_hops=1)
    assert routed(stage_options(11), "PATH").graph == "path" and routed(stage_options(11), "nonsense") == routed(stage_options(11), "lookup") and routed(stage_options(11), None) == stage_options(11) and routed(stage_options(5), "path") == stage_options(5)
    with pytest.raises(ValueError):
        stage_options(12)


def test_ask_helpers(spark):
    q = spark.createDataFrame([(1, "who made the flick")], "question_id int, question string")
    g = spark.createDataFrame([("flick", "film"), ("song", "music")], "phrase string, expansion string")
    assert rewritten(q, g).first().question == "who made the flick film"
    found = spark.createDataFrame([(1, 1, "a", 1), (1, 2, "a", 1), (1, 2, "b", 2)], "question_id int, iteration int, chunk_id string, rank int")
    assert [(r.chunk_id, r.place) for r in merged_searches(found).orderBy("place").collect()] == [("a", 1), ("b", 2)]
    ctx = spark.createDataFrame([(1, 2, "two"), (1, 1, "one")], "question_id int, rank int, text string")
    assert prompts(q, ctx, "S").first().prompt.endswith("[1] one\n\n[2] two\n\nQUESTION\nwho made the flick")
    assert cached_answers(q, spark.createDataFrame([], "key string, answer string, warning string"), ["question"]).first().cached is False


def test_every_stage_does_what_its_options_say(spark):
    rows = [(f"{s[0]}{i}", "d", s, i, i * 100, i * 100 + 100, t, y) for s in ("recursive", "contextual") for i, (t, y) in enumerate([("alpha film report", 2005), ("alpha film alpha film report", 2011), ("composer of the harbour", 2005), ("harbour bells", 2005), ("far away", 2005), ("linked tale", 1990)])]
    c = spark.createDataFrame(rows, "id string, doc_id string, strategy string, strategy_ordinal int, start_char int, end_char int, text string, year int")
    c = c.withColumns({n: F.lit(None).cast("string") for n in ("doctype", "subject", "studio")})
    q = spark.createDataFrame([(1, "alpha film 2005"), (2, "who wrote the music"), (3, "alpha report or bells")], "question_id int, question string")
    given = Inputs(
        sections=c.select("doctype", "subject", "studio", "year"), glossary=spark.createDataFrame([("music", "composer")], "phrase string, expansion string"),
        mentions=spark.createDataFrame([("d", "r2", "x"), ("d", "r5", "y")], "doc_id string, chunk_id string, entity_key string"),
        edges=spark.createDataFrame([("d", "x", "MERGE", "y", 1.0, False)], "doc_id string, subject string, predicate string, object string, confidence double, derived boolean"),
        searches=spark.createDataFrame([(3, 1, "bells"), (3, 2, "alpha report")], "question_id int, iteration int, question string"), kinds=spark.createDataFrame([(2, "simple"), (3, "multi_part")], "question_id int, kind string"),
    )
    got = {}
    for r in compare(q, c, None, [0, 2, 3, 5, 6, 9, 10, 11], given).orderBy("rank").collect():
        got.setdefault((r.stage, r.question_id), []).append(r.chunk_id)
    assert set(got[2, 1]) == {"r0", "r1"} and got[3, 1] == got[5, 1] == ["r0"] and got[9, 1] == ["c0"]
    assert (5, 2) not in got and got[6, 2] == ["r2"] and got[9, 2] == ["c2"]
    assert got[6, 3][0] != "r3" and got[9, 3][0] == "c3" and sorted(got[9, 3]) == ["c0", "c1", "c3"]
    assert got[10, 2] == ["c2", "r1", "r3", "r5"] and got[11, 2] == ["c2"] and got[11, 3] == got[10, 3] and (0, 1) not in got
    with pytest.raises(ValueError):
        retrieve(q, c, None, stage_options(3))


def test_stages_share_what_they_have_in_common(spark, monkeypatch):
    rows = [(f"{s[0]}{i}", "d", s, i, i * 100, i * 100 + 100, t, 2005) for s in ("recursive", "contextual") for i, t in enumerate(["alpha film", "beta film", "alpha beta film"])]
    c = spark.createDataFrame(rows, "id string, doc_id string, strategy string, strategy_ordinal int, start_char int, end_char int, text string, year int")
    c = c.withColumns({n: F.lit(None).cast("string") for n in ("doctype", "subject", "studio")})
    v = spark.createDataFrame([(r[0], [1.0, float(r[3] % 2)]) for r in rows], "id string, vector array<float>")
    q = spark.createDataFrame([(i, t, [1.0, 0.0]) for i, t in enumerate(["alpha film", "alpha film", "beta"])], "question_id int, question string, vector array<float>")
    given = Inputs(sections=c.select("doctype", "subject", "studio", "year"), glossary=spark.createDataFrame([("flick", "film")], "phrase string, expansion string"))
    calls = []
    for name in ("bm25", "vector_top"):
        monkeypatch.setattr(f"weftline.plans.ask.{name}", lambda *a, f=getattr(search, name), n=name, **k: calls.append(n) or f(*a, **k))
    got = {}
    for r in compare(q, c, v, [2, 3, 4, 5, 6, 7, 8, 9], given).orderBy("rank").collect():
        got.setdefault((r.stage, r.question_id), []).append(r.chunk_id)
    assert sorted(calls) == ["bm25"] * 2 + ["vector_top"] * 3  # one for each strategy and filter; there was one for each stage
    assert got[2, 0] == ["r0", "r2", "r1"] and got[5, 0] == got[5, 1] == got[6, 0] and got[7, 2] == got[8, 2] == got[9, 2] == ["c1", "c2", "c0"]
    one = {n: {(r.question_id, r.chunk_id, r.rank) for r in retrieve(q, c, v, stage_options(n), given).collect()} for n in (4, 7)}
    assert all(one[n] == {(i, x, j + 1) for (s, i), ids in got.items() if s == n for j, x in enumerate(ids)} for n in one)


def test_vectors_within_scopes(spark):
    rows = [(f"k{i:02d}", [float(i % 5 - 2), float(i % 3), 1.0]) for i in range(30)] + [("n", None), ("z", [0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "id string, vector array<float>")
    q = spark.createDataFrame([(i, [1.0, float(i), 0.5], i % 3) for i in range(6)], "question_id int, vector array<float>, scope int")
    members = spark.createDataFrame([(i % 2, k) for i, (k, _) in enumerate(rows)] + [(1, "k00")], "scope int, id string")
    got = {(r.question_id, r.id, r.rank) for r in search.vector_top(v, q, 4, digits=12, scopes=members).collect()}
    every = search.vector_scores(v, q).withColumn("score", F.round("score", 12)).join(q.select("question_id", "scope"), "question_id").join(members, ["scope", "id"], "left_semi")
    assert got == {(r.question_id, r.id, r.rank) for r in search.top_k(every, 4).collect()} and len(got) == 16


def test_figures_within_a_filter_are_those_of_the_filtered_texts(spark):
    c = spark.createDataFrame([("a", "red fox"), ("b", "red red hen house"), ("c", "blue fox"), ("d", None)], "id string, text string")
    q = spark.createDataFrame([(1, "red fox", "s"), (2, "red fox", "t")], "question_id int, question string, scope string")
    scopes = spark.createDataFrame([("s", x) for x in "abd"] + [("t", x) for x in "abcd"], "scope string, id string")
    got = {(r[0], r[1]): round(r[2], 9) for r in search.bm25(c, q, scopes=scopes).collect()}
    want = {(n, r[1]): round(r[2], 9) for n, part in ((1, c.where("id <> 'c'")), (2, c)) for r in search.bm25(part, q.where(f"question_id = {n}")).collect()}
    assert got == want and len(got) == 5


def test_files(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"relationTypes": [{"predicate": "DIRECTED", "from": ["Person"], "to": ["Film", "TVSeries"]}]}')
    (tmp_path / "n.json").write_text('{"Bob": "Robert"}')
    (tmp_path / "g.json").write_text('{"name": "g", "questions": [{"id": "q1", "question": "?", "type": "t", "expectedAnswerContains": ["x"], "expectRefusal": true}]}')
    assert files.ontology(spark, str(tmp_path / "o.json")).count() == 2
    assert files.diminutives(spark, str(tmp_path / "n.json")).first().canonical == "robert"
    assert files.golden_set(spark, str(tmp_path / "g.json")).first().expect_refusal is True
    md = spark.createDataFrame([(1, "# Title\n\ndocType: x\n| a | b |\n|---|---|\n> said **so**\n```\n# code\n```\n---\n- item")], "doc_id int, text string")
    got = [(r.kind, r.line) for r in files.flattened_markdown(md).orderBy("n").collect()]
    assert got == [("heading", "Title"), ("front", "docType: x"), ("row", "a · b"), ("quote", "said so"), ("code", "# code"), ("item", "item")]
    assert files.before_marker(spark.createDataFrame([("keep APPENDIX drop",)], "text string"), "APPENDIX").first().text == "keep"
    assert files.first_json_object('Sure:\n```json\n{"a": "}"}\n``` bye') == '{"a": "}"}' and files.first_json_object("none") is None


def test_store_replaces_by_document(spark, tmp_path):
    store = files.ParquetStore(spark, str(tmp_path))
    rows = lambda *r: spark.createDataFrame(list(r), "id string, v int, doc_id string")
    store.replace("t", rows(("1", 1, "a"), ("2", 1, "b")))
    store.replace("t", rows(("3", 2, "a")))
    assert {(r.id, r.v) for r in store.read("t").collect()} == {("3", 2), ("2", 1)}
    store.upsert("t", rows(("3", 5, "a"), ("4", 5, "a")), ["id"])
    assert {(r.id, r.v) for r in store.read("t").collect()} == {("3", 5), ("4", 5), ("2", 1)}
    store.delete("t", "a")
    assert {r.id for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {"2"}


def test_least_recently_used_goes_first(spark):
    rows = spark.range(62).select(F.col("id").cast("string").alias("key"), F.col("id").alias("used"))
    kept = {int(r.key) for r in files.most_recent(rows, "used", "key").collect()}
    assert kept == set(range(12, 62))


def test_stream_of_texts_is_chunked_once(spark, tmp_path):
    spark.createDataFrame([(1, "abc " * 1000), (2, None)], "doc_id bigint, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id bigint, text string").parquet(str(tmp_path / "in"))
    ingest.chunk_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_windows_and_word_pieces(spark):
    d = spark.createDataFrame([("a", [str(i) for i in range(600)]), ("b", ["x"]), ("c", [])], "id string, tokens array<string>")
    got = [(r.id, r.start, r.end) for r in chunking.token_windows(d).orderBy("id", "start").collect()]
    assert got == [("a", 0, 254), ("a", 190, 444), ("a", 380, 600), ("b", 0, 1)]
    assert chunking.word_pieces(["unable", "xyz", "a" * 101], {"un", "##able", "x"}) == ["un", "##able", "[UNK]", "[UNK]"]


def test_scores_without_a_model_are_halved(spark):
    d = spark.createDataFrame([(1, "a", 4.0, None), (1, "b", 2.0, 0.9), (2, "c", 0.0, None)], "question_id int, id string, lexical double, model double")
    assert {r.id: r.score for r in search.with_fallback(d).collect()} == {"a": 0.5, "b": 0.9, "c": 0.0}


def test_payloads_hits_and_lists(spark):
    held = spark.createDataFrame([("c1", "d", "s1", 2001, 5, "t"), ("c2", "d", None, None, 6, None)], "id string, doc_id string, section_id string, year int, seq int, text string")
    for c in ("doctype", "subject", "studio", "market", "page", "entity_keys"):
        held = held.withColumn(c, F.lit(None).cast("string"))
    stored = search.payloads(held, spark.createDataFrame([("s1", "One")], "id string, heading string"))
    assert len(stored.columns) == 12 and {(r.chunk_id, r.section) for r in stored.collect()} == {("c1", "One"), ("c2", None)}
    hits = spark.createDataFrame([(1, "c1", 1, 0.5), (1, "gone", 2, 0.4)], "question_id int, chunk_id string, rank int, score double")
    assert [(r.chunk_id, r.section, r.score) for r in search.retrieved(hits, stored).collect()] == [("c1", "One", 0.5)]
    runs = spark.createDataFrame([("a", 1), ("b", 3), ("c", 3), ("d", None)], "id string, started int")
    assert [r.id for r in search.newest(runs, "started", "id", 3).collect()] == ["b", "c", "a"] and search.newest(runs, "started", "id").count() == 4


def test_package_is_sent_as_an_archive(spark):
    home = os.path.dirname(os.path.dirname(os.path.abspath(runtime.__file__)))
    path = runtime.ship_package(spark, os.path.dirname(home))
    names = zipfile.ZipFile(path.removeprefix("file:")).namelist()
    assert "weftline/plans/runtime.py" in names and all(n.endswith(".py") for n in names)


def test_hops_can_be_switched_off(spark):
    own = spark.createDataFrame([("d", "c1", "fixed", 1), ("d", "c2", "fixed", 2)], "doc_id string, id string, strategy string, strategy_ordinal int")
    said = spark.createDataFrame([("d", "c1", "x"), ("d", "c2", "y")], "doc_id string, chunk_id string, entity_key string")
    tie = spark.createDataFrame([("d", "x", "P", "y", 0.9, False)], "doc_id string, subject string, predicate string, object string, confidence double, derived boolean")
    seeds = own.where("id = 'c1'").select(F.col("id").alias("chunk_id"))
    assert tuple(graph.expand(seeds, own, said, tie).first()) == ("c1", None, "c2", "x", 1, "c2")
    assert tuple(graph.expand(seeds, own, said, tie, along=False, mentioned=False, tied=False).first()) == ("c1", None, None, None, 0, None)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id string, text string")
    q = spark.createDataFrame([(1, "anything at all")], "question_id int, question string")
    assert chunking.fixed_chunks(none).count() == 0 and chunking.recursive_chunks(none).count() == 0 and search.bm25(none, q).count() == 0
    assert graph.reach(spark.createDataFrame([], "a string, b string"), spark.createDataFrame([("x",)], "key string")).count() == 1
