import base64
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import bpe, entry, mixing, neardup, pairs, repetition, segment, terms
from weftline.plans.runtime import table


# Splitting


def text_of(rng, n):
    out = []
    while sum(map(len, out)) < n:
        kind = rng.random()
        if kind < 0.05:
            out.append("x" * rng.randint(300, 2500))
        elif kind < 0.2:
            out.append("\r\n" if rng.random() < 0.5 else "\n\n")
        else:
            out.append(" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 30))) + rng.choice([". ", "! ", " ", ", ", "\t"]))
    return "".join(out)


@pytest.mark.parametrize("seed", range(60))
def test_every_cut_is_proper_where_one_exists(seed):
    rng = random.Random(seed)
    text = text_of(rng, rng.choice([500, 1601, 4000, 12000]))
    pieces = segment.split(text)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and all(e - s <= 1600 for s, e in pieces)
    runs = [len(r) for r in text.replace("\r", " ").replace("\n", " ").replace("\t", " ").split(" ")]
    if not any(1200 < r <= 1600 for r in runs):
        assert segment.proper(text, pieces)


def test_a_run_almost_as_long_as_the_limit_is_cut_inside():
    text = "word " * 40 + "x" * 1590 + " word" * 400
    pieces = segment.split(text)
    assert all(e - s <= 1600 for s, e in pieces) and all(a[1] > b[0] for a, b in zip(pieces, pieces[1:]))


def test_deepest_valley_wins():
    one, two = "river boat water fish. " * 50, "court judge trial law. " * 70
    text = one + two
    assert abs(segment.split(text)[0][1] - len(one)) <= 1


def test_proper_sees_each_fault():
    text = "Alpha beta gamma delta. " * 200
    good = segment.split(text)
    assert segment.proper(text, good)
    assert not segment.proper(text, []) and not segment.proper(text, good[:-1]) and not segment.proper(text, good[1:])
    shifted = [(s, e) if k != 1 else (s + 3, e) for k, (s, e) in enumerate(good)]
    assert not segment.proper(text, shifted)
    assert not segment.proper(text, [good[0], (good[0][1], good[0][1] + 1600), *good[2:]])
    assert not segment.proper("a. " * 600, [(0, 1800)])
    assert segment.proper("y" * 4000, [(0, 1600), (1500, 3100), (3000, 4000)])


def test_split_of_nulls_and_blanks(spark):
    d = spark.createDataFrame([("a", None, 1), ("b", "", 1), ("c", " \n", 1), ("d", "one", 1), ("d", "one", 1)], "id string, text string, start_char int")
    assert [tuple(r) for r in segment.split_texts(d).collect()] == [("d", 0, 3, "recursive")]
    none = spark.createDataFrame([], "id string, section_id string, strategy string, start_char int, end_char int")
    sections = spark.createDataFrame([("s", 5, "Word one two. " * 200)], "id string, start_char int, text string")
    got = segment.recut(sections, none).first()
    assert got.faulty and segment.proper("Word one two. " * 200, [(p.start_char, p.end_char) for p in got.pieces])
    stored = spark.createDataFrame([("c", "s", "recursive", 5 + p.start_char, 5 + p.end_char) for p in got.pieces] * 2, none.schema)
    assert not segment.recut(sections, stored).first().faulty
    assert segment.recut(sections.limit(0), stored).count() == 0


# Encoding


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=300) | st.text(alphabet="ab é\n'<|endoftext|>tho", max_size=600))
def test_ids_are_those_of_the_public_library(reference, text):
    assert bpe.encoder(bpe.VOCABULARY).encode_batch([text])[0] == reference.encode_ordinary(text)


def test_long_runs_and_documents(spark, data, reference):
    texts = ["a" * 30000, "abc" * 9000, " " * 4000, "<|endoftext|>", None, ""]
    assert bpe.encoder(bpe.VOCABULARY).encode_batch(texts) == [reference.encode_ordinary(t or "") for t in texts]
    docs = {r.doc_id: r.text for r in table(spark, data, "documents").collect()}
    got = {r.doc_id: r.ids for r in entry.p8_ids(spark, data).collect()}
    assert got == {k: reference.encode_ordinary(t or "") for k, t in docs.items()}
    assert all(reference.decode(v) == (docs[k] or "") for k, v in got.items())


def test_clashing_columns_and_empty_table(spark):
    d = spark.createDataFrame([("k", "text one", 1, 2)], "doc_id string, text string, ids int, tokens int")
    assert bpe.encode(d).first().ids and bpe.token_counts(d).first().tokens == 2
    assert bpe.encode(d.limit(0)).count() == 0


# Repetition


def repeated_by_hand(text):
    words = repetition.WORD.findall((text or "").lower())
    hit = [False] * len(words)
    for i in range(len(words) - 4):
        if any(words[j : j + 5] == words[i : i + 5] for j in range(i)):
            hit[i : i + 5] = [True] * 5
    return len(words), sum(hit)


def test_repetition_against_brute_force(spark, data):
    docs = table(spark, data, "documents").collect()
    got = {r.doc_id: (r.words, r.repeated_words) for r in repetition.repetition_scores(table(spark, data, "documents")).collect()}
    assert got == {r.doc_id: repeated_by_hand(r.text) for r in docs}
    want = {k for k, (n, m) in got.items() if n >= 20 and m * 10 >= n * 3}
    assert {r.doc_id for r in entry.p10_found(spark, data).collect()} == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "Über", "7"]), max_size=60))
def test_repetition_of_few_words(words):
    text = " ".join(words)
    assert repetition.measure(text, {})[:2] == repeated_by_hand(text)


def test_repeated_lines_and_edges():
    assert repetition.measure("same line here\nsame line here\nother", {})[-1] == pytest.approx(14 / 33, abs=1e-6)
    assert repetition.measure(None, {})[:2] == (0, 0) and repetition.measure("", {})[-1] == 0.0


# Terms


def test_scores_against_the_formula(spark):
    d = spark.createDataFrame([("1", "river river boat", ["k", "k", None]), ("2", "boat the", []), ("3", None, None), ("1", "river river boat", ["k", "k", None])], "id string, text string, entity_keys array<string>").withColumn("doc_id", F.lit("d")).withColumn("score", F.lit(9))
    got = {(r.id, r.term): r for r in terms.word_scores(d).collect()}
    n, row, col, grand = 2, 3, 2, 5
    e = row * col / grand
    assert got["1", "river"].score == pytest.approx((n - e) / (e * (1 - row / grand) * (1 - col / grand)) ** 0.5, abs=1e-4)
    assert set(got) == {("1", "river"), ("1", "boat"), ("2", "boat"), ("2", "the")}
    assert [r.score for r in terms.key_scores(d).collect()] == [None]
    assert terms.word_scores(d.limit(0)).count() == 0 and terms.key_scores(d.limit(0)).count() == 0


def test_scores_cover_every_cell_once(spark, data):
    chunks = table(spark, data, "chunks")
    got = terms.all_scores(chunks)
    want = sum(len(set(terms.WORD.findall(r.text.lower()))) + len(set(r.entity_keys)) for r in chunks.select("id", "text", "entity_keys").distinct().collect())
    assert got.count() == want == got.select("chunk_id", "kind", "term").distinct().count()


def test_found_terms_need_no_scores(spark, monkeypatch):
    rows = [
        ("1", "a", "fixed", "Vault vault VAULT sea sea sea film film film", ["film", "one", "k", "k", None]), ("1", "a", "fixed", "Vault vault VAULT sea sea sea film film film", ["film", "one", "k", "k", None]),
        ("2", "b", "fixed", "film vault", ["k", "two"]), ("3", "b", "fixed", None, ["two", "film"]), ("4", "c", "fixed", "film reel reel reel", ["k3"]), ("5", "d", "fixed", "film reel", ["k3", "k"]),
        ("6", "c", "fixed", "", None), ("7", "e", "recursive", "reel lamp lamp lamp", ["k", "one"]),
    ]
    d = spark.createDataFrame(rows, "id string, doc_id string, strategy string, text string, entity_keys array<string>").withColumn("score", F.lit(9))
    monkeypatch.setattr(terms, "adjusted_residual", None)
    assert sorted(map(tuple, terms.distinctive(d).collect())) == [("1", "film"), ("1", "k"), ("1", "vault"), ("2", "k"), ("3", "film"), ("4", "k3"), ("4", "reel"), ("5", "k"), ("5", "k3")]
    whole = spark.createDataFrame([("1", "a", "fixed", "reel reel reel", [])], "id string, doc_id string, strategy string, text string, entity_keys array<string>")
    assert [tuple(r) for r in terms.distinctive(whole).collect()] == [("1", "reel")] and terms.distinctive(d.limit(0)).count() == 0


# Near duplicates


def test_near_duplicates_against_brute_force(spark, data):
    texts = neardup.corpus_texts(table(spark, data, "sections"), table(spark, data, "chunks")).distinct().collect()
    bags = [(r.kind, r.id, Counter(neardup.WORD.findall(r.text.lower()))) for r in texts]
    bags = [(k, i, b, sum(b.values())) for k, i, b in bags if sum(b.values()) >= 60]
    want = {(min(i, j), max(i, j)) for x, (k, i, a, n) in enumerate(bags) for m, j, b, o in bags[:x] if k == m and i != j and 10 * sum((a & b).values()) >= 4 * (n + o)}
    assert {tuple(r) for r in entry.p4_found(spark, data).collect()} == want and want


def test_sketches_tell_alike_from_unlike():
    rng = np.random.default_rng(11)
    for share, low, high in ((0.53, neardup.AGREEING, 480), (0.2, 0, neardup.AGREEING - 1)):
        for _ in range(20):
            both = round(2 * 200 * share / (1 + share))
            x = rng.integers(0, 2**32, 400 - both, dtype=np.uint64).astype(np.uint32)
            a, b = (pa.array([neardup.sketch(neardup.elements(s))], pa.binary()) for s in (x[:200], x[200 - both :]))
            assert low <= neardup.agreeing(a, b)[0] <= high
    assert neardup.agreeing(pa.array([None], pa.binary()), a).tolist() == [-1]


def test_hot_sketches_are_broadcast(spark):
    pairs = spark.createDataFrame([(1, i) for i in range(2, 60)] + [(5, 6)], "a bigint, b bigint")
    sketches = spark.createDataFrame([(i, bytes([i]), None) for i in range(1, 60)], "uid bigint, rare binary, every binary")
    got = {(r.a, r.b, bytes(r.ra)) for r in neardup.with_sketch(pairs, sketches, "a", hot_pairs=10).collect()}
    assert got == {(1, i, b"\x01") for i in range(2, 60)} | {(5, 6, b"\x05")}


def test_hot_contents_are_dealt_to_several_parts(spark):
    pairs = spark.createDataFrame([(1, i) for i in range(2, 60)] + [(5, 6)], "a bigint, b bigint")
    content = spark.createDataFrame([(i, f"text {i}") for i in range(1, 60)], "uid bigint, text string")
    got = {tuple(r) for r in neardup.with_text(pairs, content, "a", "b", hot_pairs=10).select("a", "b", "ta").collect()}
    assert got == {(1, i, "text 1") for i in range(2, 60)} | {(5, 6, "text 5")}


def test_copies_and_classes(spark):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 400)}" for _ in range(100)]
    near = base[:]
    rng.shuffle(near)
    near[:5] = ["new"] * 5
    rows = [("s", str(i), " ".join(base)) for i in range(300)] + [("s", "near", " ".join(near)), ("s", "far", "other words " * 50), ("s", "short", "few words"), ("s", "null", None), ("c", "0", " ".join(base)), ("s", "0", " ".join(base))]
    d = spark.createDataFrame(rows, "kind string, id string, text string").withColumn("uid", F.lit(1)).withColumn("a", F.lit(2))
    links, members = neardup.near_duplicate_contents(d)
    assert links.count() == 2 and members.count() == 304
    classes = {(r.kind, r.id): (r.class_id, r.links) for r in neardup.near_duplicate_classes(d).collect()}
    assert classes["s", "near"] == ("0", 300) and classes["s", "17"] == ("0", 300)
    assert classes["s", "far"] == ("far", 0) and classes["c", "0"] == ("0", 0) and classes["s", "null"] == ("null", 0)
    assert neardup.near_duplicates(d).count() == 300 * 299 // 2 + 300
    assert neardup.near_duplicates(d.limit(0)).count() == 0 and neardup.near_duplicate_classes(d.limit(0)).count() == 0


def test_large_buckets_are_paired_in_blocks():
    import pyarrow as pa

    ids = list(range(300))
    batch = pa.RecordBatch.from_arrays([pa.array([7] * 300, pa.int64()), pa.array(ids, pa.int64())], ["bucket", "uid"])
    got = set()
    for b in neardup._partners(iter([batch])):
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            assert len(x) <= neardup.BLOCK
            got |= {(min(i, j), max(i, j)) for i in x for j in y if i != j}
    assert len(got) == 300 * 299 // 2


# Pairs


CASES = [
    ("Who directed The Thaw?", None, "empty"), ("Who directed The Thaw?", "​ [1]", "empty"), ("Who directed The Thaw?", "Answer:", "empty"), ("Who directed The Thaw?", "(no answer)", "empty"),
    ("Who directed The Thaw?", "who directed the thaw", "copies_question"), ("Who directed The Thaw?", 'Question: "Who directed The Thaw?"', "copies_question"), ("Who directed The Thaw?", "Who directed The Thaw? Dara Okonjo.", None),
    ("Who directed The Thaw?", "I'm unable to help with this question.", "refusal"), ("Qui a réalisé The Thaw ?", "Le dossier ne contient pas cette information.", "refusal"), ("Wer führte bei The Thaw Regie?", "Leider kann ich das anhand der Auszüge nicht beantworten.", "refusal"),
    ("¿Quién dirigió The Thaw?", "Lo siento, no puedo responder con el material disponible.", "refusal"), ("Who refused the part?", "Dara Okonjo refused the part owing to a tax ruling.", None), ("When was it found?", "The negative was not found until 1994, when it surfaced in Quillmouth.", None),
    ("Who directed The Thaw?", "Le film a été réalisé par Dara Okonjo.", "wrong_language"), ("Who directed The Thaw?", "監督はDara Okonjo、上映時間は110分。", "wrong_language"), ("¿Dónde se rodó la escena final de The Thaw?", "La escena final se rodó en Greyfen, cerca del puerto viejo.", None),
    ("Who directed The Thaw?", 'It was Dara. The local title was "港の灯".', None), ("How long is it?", "The domestic cut runs 105 minutes [1]. However, while", "truncated"), ("How long is it?", 'It runs 100 minutes. It also "won the', "truncated"),
    ("How long is it?", "It runs 100 minutes (197", "truncated"), ("Name three films.", "1. The Thaw.\n2. Vermilion.\n3.", "truncated"), ("In which year was it released?", "It was released in 2024", None), ("How many?", "50", None), ("Where was it shot?", "The sequence was shot in Quillmouth [2]", None),
]


@pytest.mark.parametrize("question, answer, want", CASES)
def test_defects(question, answer, want):
    assert pairs.judge(f"### system\nx\n\n### user\nCONTEXT\n[1] y\n\nQUESTION\n{question}", answer)[0] == want


def test_question_of():
    assert pairs.question_of("### user\r\nA?\r\n") == "A?" and pairs.question_of("### user\nx\nQUESTION\nB?") == "B?" and pairs.question_of(None) == ""


@pytest.mark.parametrize(
    ("answer", "defect"),
    [
        ("<ul><li>Ann Lee</li><li>Bo Ray.", "truncated"), ("<ul><li>Ann Lee</li><li>Bo Ray.</li></ul>", None), ("<p>Ann Lee.", None), ('It is <a href="x', "truncated"),
        ("**Ann Lee. She made it.", "truncated"), ("**Ann Lee** made it.", None), ("* One thing.\n* Another thing.", None), ("The file snake_case_name is whole.", None),
        ("Run `make all.", "truncated"), ("```\nprint(\n```", None), ("```\nprint(1)", "truncated"), ("- Ann Lee\n- Bo Ray", None), ("- Ann Lee\n-", "truncated"),
        ("See (Ann Lee (1921). It is so.", "truncated"), ("See a) first and b) second.", None), ('The disc is 5" wide.', None), ("She said “no.", "truncated"), ("„Ann Lee“ made it.", None),
        ("The documents from 1921 do not survive, so Ann Lee is credited.", None), ("The documents do not say who did.", "refusal"), ("Mi dispiace, non posso rispondere.", "refusal"),
    ],
)
def test_pushdown_parser_and_refusals(answer, defect):
    assert pairs.judge("### user\nWho directed the film?", answer)[0] == defect


def test_scripts_are_told_by_name():
    assert pairs.judge("QUESTION\nКто снял этот фильм в 1921 году?", "この映画は一九二一年に作られました。")[0] == "wrong_language"
    assert pairs.judge("QUESTION\nКто снял этот фильм в 1921 году?", "Его сняла Анна Ли.")[0] is None


def test_vocabulary_tells_fragments_from_words(spark):
    rows = [(1, "Who? glass eye", "The character inherits a glass eye"), (2, "Who?", "The rights went to Zolak"), (3, "Zolakovik Films?", "Rights: Zolak"), (None, "Q", None), (4, None, "It was made in Greyfen by hand."), (1, "Who? glass eye", "The character inherits a glass eye")]
    d = spark.createDataFrame(rows, "answer_id bigint, prompt string, answer string").withColumn("word", F.lit("x")).withColumn("defect", F.lit("y"))
    assert {tuple(r) for r in pairs.defective_pairs(d).collect()} == {(2, "truncated"), (3, "truncated")}
    assert pairs.defective_pairs(d.limit(0)).count() == 0


def test_long_words_are_found_by_their_beginnings(spark):
    whole = "Donaudampfschifffahrtselektrizitätenhauptbetriebswerk"
    rows = [(1, f"{whole}?", f"The rights went to {whole[:30]}"), (2, "Who?", f"The rights went to {whole[:24]}"), (3, "Who?", f"The rights went to {whole}"), (4, "Who?", f"The rights went to {whole[:30]}x")]
    d = spark.createDataFrame(rows, "answer_id bigint, prompt string, answer string")
    assert {tuple(r) for r in pairs.defective_pairs(d).collect()} == {(1, "truncated"), (2, "truncated")}


def test_beginnings_of_any_length_against_brute_force(spark):
    rng = random.Random(3)
    heads = ["".join(rng.choice("abé") for _ in range(pairs.LISTED - 2)) for _ in range(3)]
    token = lambda: (rng.choice(heads) + "".join(rng.choice("abé\U0001d51e") for _ in range(rng.randint(0, 9))))[rng.choice((0, 0, 0, 18)) :]
    known, sought = {token() for _ in range(1500)}, {token() for _ in range(800)}
    frame = lambda s: spark.createDataFrame([(t,) for t in sorted(s)], "token string")
    got = sorted(r.token for r in pairs._begun(frame(sought), frame(known)).collect())
    want = sorted(t for t in sought if any(k != t and k.startswith(t) for k in known))
    assert got == want and any(len(t) > pairs.LISTED for t in want) and any(len(t) <= pairs.LISTED for t in want) and len(want) < len(sought)


# Mixing


def test_weights_keep_reachable_targets_and_limits():
    tokens, repeats = {"a": 900, "b": 90, "c": 10}, {"a": 1, "b": 4, "c": 2, "d": 1}
    targets = {"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.1}
    got, exponent = mixing.fit_weights(tokens, targets, repeats, 1000)
    assert sum(got.values()) == pytest.approx(1000) and got["c"] == 20 and got["d"] == 0
    assert got["a"] >= 500 / 1.1 and 300 / 1.1 <= got["b"] <= 360 and 0 <= exponent <= 1
    assert mixing.fit_weights(tokens, {"a": 0.7, "b": 0.29, "c": 0.01}, repeats, 1000) == ({"a": 700, "b": 290, "c": 10}, None)
    everything, _ = mixing.fit_weights(tokens, targets, repeats, 5000)
    assert everything == pytest.approx({"a": 900, "b": 360, "c": 20, "d": 0})


def test_exponent_keeps_the_entropy_of_the_targets_among_sources_with_room():
    targets = {"a": 0.45, "b": 0.25, "c": 0.15, "d": 0.15}
    draw, exponent = mixing.fit_weights({"a": 9000, "b": 2000, "c": 900, "d": 100}, targets, {"a": 1, "b": 2, "c": 5, "d": 1}, 9000)
    among = lambda w: mixing.entropy({s: w[s] for s in "abc"})
    assert 0 < exponent < 1 and among(draw) == pytest.approx(among(targets), abs=1e-9)
    assert draw["d"] == 100 and sum(draw.values()) == pytest.approx(9000) and all(draw[s] >= 9000 * targets[s] for s in "abc")
    assert mixing.tempered({"a": 0.7, "b": 0.3}, 0) == {"a": 0.5, "b": 0.5} and mixing.tempered({"a": 0.7, "b": 0.3}, 1) == pytest.approx({"a": 0.7, "b": 0.3})


def test_what_capped_sources_leave_is_refilled(spark):
    docs = spark.createDataFrame([(i, "abc"[i % 3], 1 if i % 3 == 2 else 10) for i in range(3000)], "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("a", 0.4, 2), ("b", 0.2, 3), ("c", 0.4, 2)], "source string, target_share double, max_repeats int")
    for per_range in (2, 4096):  # many ranges of blocks, and one
        got = {r.source: r for r in mixing.mix(docs, targets, block_tokens=500, range_blocks=per_range)[1].collect()}
        assert got["c"].tokens == 2000 and 21000 - 30 <= sum(r.tokens for r in got.values()) <= 21000
        assert got["a"].tokens >= 0.4 * 21000 - 10 and got["b"].tokens >= 0.2 * 21000 - 10 and all(r.tokens <= r.max_repeats * r.available_tokens for r in got.values())


def test_mix_reaches_shares_without_breaking_limits(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, "big" if i < 2000 else "small", rng.randint(1, 60), 7) for i in range(2100)] + [(None, "big", 5, 7), (9000, None, 5, 7), (5, "big", 3, 7)][:2], "doc_id bigint, source string, tokens bigint, block int")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.2, 3), ("gone", 0.1, 2), ("big", 0.7, 1)], "source string, target_share double, max_repeats int")
    drawn, shares = mixing.mix(docs, targets, block_tokens=500)
    rows, reached = drawn.collect(), {r.source: r for r in shares.collect()}
    assert len({r.doc_id for r in rows}) == len(rows) and all(r.repeats <= (1 if r.source == "big" else 3) for r in rows)
    for s in ("big", "small"):
        own = sum(r.tokens * r.repeats for r in rows if r.source == s)
        assert own == reached[s].tokens and reached[s].wanted_tokens - 60 <= own <= reached[s].wanted_tokens
    assert reached["gone"].tokens == 0 and sum(r.actual_share for r in reached.values()) == pytest.approx(1, abs=1e-5)
    none = mixing.mix(docs.limit(0), targets)[1].collect()
    assert len(none) == 3 and all(r.actual_share == 0 for r in none)
