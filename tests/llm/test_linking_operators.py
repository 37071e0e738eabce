import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import components, entry, knn, names
from weftline.plans.runtime import table


# Groups


def groups_by_hand(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for s, a, b in edges:
        if None not in (s, a, b) and a != b:
            x, y = find((s, a)), find((s, b))
            parent[max(x, y)] = min(x, y)
    return {(s, k, find((s, k))[1]) for s, k in parent}


def random_edges(seed, n=400):
    rng = random.Random(seed)
    chain = [("c", f"{i:04d}", f"{i + 1:04d}") for i in range(150)]
    star = [("h", "zz", f"n{i:03d}") for i in range(300)]
    loose = [("r", f"k{rng.randint(0, 300)}", f"k{rng.randint(0, 300)}") for _ in range(n)]
    out = chain + star + loose + [("r", "x", "x"), ("r", None, "y"), (None, "a", "b")]
    rng.shuffle(out)
    return out + out[:50]


@pytest.mark.parametrize("most", [components.MAX_EDGES, 60])
def test_groups_against_union_find(spark, most):
    edges = random_edges(1)
    d = spark.createDataFrame(edges, "doc string, l string, r string").withColumn("child", F.lit("x")).withColumn("scope", F.lit("y")).repartition(5)
    got = [tuple(r) for r in components.connected_groups(d, "doc", "l", "r", max_edges=most).collect()]
    assert len(got) == len(set(got)) and set(got) == groups_by_hand(edges)


def test_hubs_are_lifted_by_broadcast(spark):
    edges = random_edges(2)
    d = spark.createDataFrame([e for e in edges if None not in e and e[1] != e[2]], "scope string, child string, root string").repartition(5)
    forest = components._alternate(components._local(d, 60), 60, hub_rows=20)
    got = {tuple(r) for r in forest.select("scope", "child", "root").collect()}
    assert got == {x for x in groups_by_hand(edges) if x[1] != x[2]}


def test_no_edges(spark):
    assert components.connected_groups(spark.createDataFrame([], "d string, l string, r string"), "d", "l", "r").count() == 0


def test_merge_decisions(spark, data):
    rows = table(spark, data, "merge_decisions").collect()
    edges = [(r.doc_id, r.left_key, r.right_key) for r in rows if r.decision and r.decision.strip().lower() == "merge"]
    assert {tuple(r) for r in entry.p7_found(spark, data).collect()} == groups_by_hand(edges)


# Neighbours


def neighbours_by_hand(rows, k, least=-2.0):
    spaces = defaultdict(dict)
    for s, i, v in rows:
        if s is not None and i is not None and v is not None and any(v):
            spaces[s][i] = np.asarray(v, float) / np.linalg.norm(v)
    out = {}
    for s, own in spaces.items():
        for i, v in own.items():
            near = sorted(((-round(float(v @ w), 6), j) for j, w in own.items() if j != i))[:k]
            out[s, i] = [j for c, j in near if -c >= least]
    return out


def test_recall_against_brute_force(spark, data):
    vectors = knn.archive_vectors(table(spark, data, "vectors"), table(spark, data, "embedding_cache"))
    want = neighbours_by_hand([tuple(r) for r in vectors.collect()], 5)
    got = defaultdict(set)
    for r in knn.nearest(vectors).collect():
        got[r.space, r.id].add(r.other)
    hits = sum(len(got[x] & set(w)) for x, w in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))


@pytest.mark.parametrize("long", [False, True])
def test_recall_with_lists_found_by_a_tree(spark, monkeypatch, long):
    if long:  # every list is dealt to blocks
        monkeypatch.setattr(knn, "BLOCK_ROWS", 20)
        monkeypatch.setattr(knn, "BLOCK_VISITORS", 60)
    rng = np.random.default_rng(5)
    heads = rng.normal(size=(60, 24))
    rows = [("s", f"r{i:04d}", [float(x) for x in heads[i % 60] + 0.5 * rng.normal(size=24)]) for i in range(1500)]
    got = defaultdict(set)
    for r in knn.nearest(spark.createDataFrame(rows, "space string, id string, vector array<double>"), list_rows=25, flat_lists=16).collect():
        got[r.space, r.id].add(r.other)
    want = neighbours_by_hand(rows, 5)
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
    assert sum(len(got[x] & set(w)) for x, w in want.items()) >= 0.9 * 5 * len(want)


def test_more_ties_than_neighbours_go_to_smaller_ids():
    base = np.eye(4, dtype=np.float32)[[1] * 40 + [0]]
    i, j, c = knn.scan(np.eye(4, dtype=np.float32)[:2], base, 5, -1.0, np.array([-1, 3]))
    assert j[i == 1].tolist() == [0, 1, 2, 4, 5] and j[i == 0].tolist() == [40, 0, 1, 2, 3]


def test_mutual_pairs_against_brute_force(spark, data):
    vectors = knn.archive_vectors(table(spark, data, "vectors"), table(spark, data, "embedding_cache"))
    near = neighbours_by_hand([tuple(r) for r in vectors.collect()], 5, 0.9)
    want = {(i, j) for (s, i), ns in near.items() for j in ns if i < j and i in near[s, j]}
    got = {tuple(r) for r in entry.p6_found(spark, data).collect()}
    assert len(want & got) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(got)


def test_copies_nulls_and_widths(spark):
    rng = np.random.default_rng(0)
    same = [float(x) for x in rng.normal(size=8)]
    rows = [("s", f"c{i:03d}", same) for i in range(400)] + [("s", f"r{i}", [float(x) for x in rng.normal(size=8)]) for i in range(50)]
    rows += [("s", "null", None), ("s", "zero", [0.0] * 8), ("s", "none", []), ("t", "one", [1.0, 2.0]), (None, "x", same), ("s", "c000", same)]
    d = spark.createDataFrame(rows, "space string, id string, vector array<double>").withColumn("list", F.lit(1)).withColumn("own", F.lit(2)).withColumn("h", F.lit(3))
    pairs = {tuple(r) for r in knn.mutual_pairs(d).where("left_id like 'c%' and right_id like 'c%'").collect()}
    assert pairs == {("s", f"c{i:03d}", f"c{j:03d}") for i in range(6) for j in range(i + 1, 6)}
    assert knn.nearest(d).where("id in ('null', 'zero', 'none', 'one')").count() == 0
    assert knn.nearest(d.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast", [10_000, 0])
def test_every_copy_has_neighbours(spark, monkeypatch, broadcast):
    monkeypatch.setattr(knn, "BROADCAST_COPIED", broadcast)
    rng = np.random.default_rng(3)
    same, few = ([float(x) for x in rng.normal(size=8)] for _ in range(2))
    rows = [("s", f"c{i:03d}", same) for i in range(40)] + [("s", f"f{i}", few) for i in range(3)] + [("s", f"r{i}", [float(x) for x in rng.normal(size=8)]) for i in range(20)]
    rows += [("s", "a", [2.0 * x for x in same[:7]] + [2.0 * same[7] + 1e-4]), ("s", "c039", same)]
    got = defaultdict(list)
    for r in knn.nearest(spark.createDataFrame(rows, "space string, id string, vector array<double>")).orderBy("rank").collect():
        got[r.space, r.id].append(r.other)
    want = neighbours_by_hand(rows, 5)
    assert {x: got[x] for x in want if x[1][0] == "c"} == {x: w for x, w in want.items() if x[1][0] == "c"}
    assert set(got) == set(want) and all(len(w) == 5 for w in got.values())


def test_abandoned_pairs_are_the_far_ones():
    rng = np.random.default_rng(1)
    x = knn.unit_rows(rng.normal(size=(500, 64))) @ knn.rotation(64)
    x = np.concatenate([x, knn.unit_rows(x[:100] + 0.03 * rng.normal(size=(100, 64)))]).astype(np.float32)
    i, j, c = knn.scan(x, x, 5, 0.9, np.arange(len(x)))
    full = x @ x.T
    np.fill_diagonal(full, -1)
    want = set(zip(*map(list, np.nonzero(full >= 0.9))))
    assert set(zip(i.tolist(), j.tolist())) == {(int(a), int(b)) for a, b in want}


# Names


NICK = {("penny", "penelotte"), ("max", "maximilor")}
GIVEN = {"penelotte", "maximilor", "junot", "nilmini", "bodhan", "birgit", "umeko", "dragan", "amaru"}


@pytest.mark.parametrize(
    "a, b, fit",
    [
        ("Penelotte Brahejaldovik", "Brahejaldovik, Penelotte", 4), ("Penelotte Brahejaldovik", "Penny Brahejaldoivk", 2), ("Dr. Junot Brihupútovik Jr", "JUNOT BRIHUPUTOVIK", 4), ("Jun. Brihuputovik", "Junot Brihuputovik", 2), ("B. Chemusatul", "Bodhan Chemusatul", 1),
        ("Nilmini Chapebildovik", "Maximilor Chapebildovik", 0), ("Umeko Bratemilovik", "Umeko Dragan Bratemilovik", 3), ("Umeko Amaru Bratemilovik", "Umeko Dragan Bratemilovik", 0), ("Max Chaipuntavul", "Maximilor Chipuntavul", 2), ('Maximilor "Milo" Chipuntavul', "Milo Chipuntavul", 2),
        ("Yasodi Poketiken (uncredited)", "Poketiken Yasodi", 0), ("Bodhan Poketiken (uncredited)", "Poketiken Bodhan", 4), ("Bodhan-Mofoguda", "Bodhan Mofoguda", 4),
    ],
)
def test_persons(a, b, fit):
    n = names.Names(GIVEN, NICK)
    assert n.compare("Person", a, b)[0] == fit and n.compare("Person", b, a)[0] == fit


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("Chogabosen Station Cine.", "CHOGABOSEN STATION CINEMA", True), ("The Dihorloba & Kingdom Entertainment", "Kingdom Dihorloba Films Ltd", True), ("Shohuguden Lighthouse", "Shohuguden Lighthouse Cinema GmbH", True), ("Radusomul Station Cinema", "Chogabosen Station Cinema", False),
        ("Mimoluldul Films", "Mmoluldul Films", True), ("Matosanul Sparrow Films", "Matosanul Mirror Films", False), ("Films", "Pictures", False),
    ],
)
def test_studios(a, b, same):
    assert (names.Names(set(), set()).compare("Studio", a, b)[0] == 4) == same


def test_links_go_through_third_rows_but_not_through_doubtful_ones(spark):
    rows = [("d", "1", "Person", "Bodhan Chemusatul", ["Iron Ash"]), ("d", "2", "Person", "Iron Ash", None), ("d", "3", "Person", "B. Chemusatul", []), ("d", "4", "Person", "Birgit Chemusatul", [None, " "]), ("e", "1", "Person", "Bodhan Chemusatul", None), ("e", "5", "Person", "Chemusatul, B.", None), ("d", "6", "Person", None, None), ("d", "7", "Film", "Bodhan Chemusatul", None), (None, "8", "Person", "Bodhan Chemusatul", None)]
    rows += [("d", "1", "Person", "Bodhan Chemusatul", ["Iron Ash"])]
    d = spark.createDataFrame(rows, "doc_id string, key string, type string, name string, aliases array<string>").withColumn("scope", F.lit("x")).withColumn("form", F.lit("y"))
    short = spark.createDataFrame([], "short_form string, canonical string")
    assert {tuple(r) for r in names.variant_pairs(d, short).collect()} == {("d", "1", "2"), ("e", "1", "5")}
    assert names.variant_pairs(d.limit(0), short).count() == 0


@pytest.mark.parametrize("hot", [names.HOT_FORMS, 3])
def test_join_meets_what_all_pairs_meet(spark, data, hot):
    forms = names.forms_of(table(spark, data, "graph_entities"), ("Person", "Studio"))
    common, nick = names.given_names(forms, table(spark, data, "name_diminutives"))
    known = names.frequencies(forms)
    rows = [(r.scope, r.type, r.form, r.form_id) for r in forms.collect()]
    judge, want = names.Names(common, nick, known), set()
    for n, (scope, kind, x, i) in enumerate(rows):
        for other, _, y, j in rows[n + 1 :]:
            if scope == other and judge.compare(kind, x, y)[0]:
                want.add(frozenset((i, j)))
    got = [frozenset((r.fa, r.fb)) for r in names.linked_forms(forms, known, common, nick, hot).collect()]
    assert len(got) == len(set(got)) and len(want) > 20 and set(got) == want


def test_rare_words_count_more_than_common_ones():
    n = names.Names({"ann", "bea", "carl"}, set())
    assert n.soft(("lee", "ann"), ("lee",), [("lee", "lee", 1.0)], []) > n.soft(("lee", "ann"), ("ann",), [("ann", "ann", 1.0)], [])
    assert n.compare("Person", "Ann Lee", "Bea Lee")[0] == 0 and n.compare("Person", "Ann Bea Lee", "A. Lee")[0] == 1
    assert n.compare("Studio", "One Two Three Four Fiveten Films", "Fivetem Four Three Two One")[0] == 4
    assert n.compare("Studio", "One Two Films", "One Films")[0] == 0
