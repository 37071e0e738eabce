from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.functions import vectors as V


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<double>' if isinstance(v, list) else 'int'}" for k, v in values.items())).select(column.alias("x")).first()[0]


def test_figures_stay_whole(spark):
    got = one(spark, X.search_tokens(F.col("t")), t="Domestic opening weekend LKR 3,571,150,070 and $47.3M besides.")
    assert got == ["domestic", "opening", "weekend", "lkr", "3,571,150,070", "$47.3m", "besides"]


def test_query_tokens_are_distinct_and_bounded(spark):
    got = one(spark, X.query_tokens(F.col("t"), 2), t="river river lantern bridge")
    assert got == ["river", "lantern"]


def test_sentences_keep_decimals(spark):
    assert one(spark, X.sentences(F.col("t")), t="It took $4.5M. Then!\nEnd") == ["It took $4.5M.", "Then!", "End"]


def test_grounding_ignores_typography(spark):
    d = spark.createDataFrame([("COMPOSED   BY  Nadun", "the music was composed by nadun."), ("by Nadun wrote", "composed by Nadun"), (None, "x"), ("ab", "ab")], "e string, t string")
    assert [r[0] for r in d.select(X.is_grounded(F.col("e"), F.col("t"))).collect()] == [True, False, False, False]


def test_evidence_is_repaired_with_the_shortest_sentence(spark):
    d = spark.createDataFrame([("Ana shot The Thaw with a crew of nine. Ana shot The Thaw. Others left.", ["Ana", "The Thaw"]), ("Nobody", ["Ana"])], "t string, n array<string>")
    assert [r[0] for r in d.select(X.repaired_evidence(F.col("t"), F.col("n"))).collect()] == ["Ana shot The Thaw.", None]


def test_titles_persons_and_studios_have_normal_forms(spark):
    titles = spark.createDataFrame([("The Thaw",), ("Thaw, The",), ("Vermilion: Part II",), ("Vermilion Part 2",), ("Harbour",)], "t string").select(X.normal_title(X.folded(F.col("t")))).collect()
    a, b, c, d, e = (r[0] for r in titles)
    assert a == b == "thaw" and c == d == "vermilion part 2" and e == "harbour"
    people = spark.createDataFrame([("Bob Vance",), ("Robert Vance",), ("James Vance Jr",), ("James Vance",)], "t string").select(X.normal_person(X.folded(F.col("t")), {"bob": "robert"})).collect()
    assert people[0][0] == people[1][0] and people[2][0] == people[3][0]
    studios = spark.createDataFrame([("Halcyon Films Ltd",), ("Halcyon",), ("Films",)], "t string").select(X.normal_studio(X.folded(F.col("t")))).collect()
    assert [r[0] for r in studios] == ["halcyon", "halcyon", "films"]


def test_initials(spark):
    d = spark.createDataFrame([("j. r. vance", "james robert vance"), ("j. vance", "robert vance"), ("james vance", "james vance"), ("j. vance", "james robert vance")], "a string, b string")
    assert [r[0] for r in d.select(X.initials_agree(F.col("a"), F.col("b"))).collect()] == [True, False, False, False]


def test_jaro_winkler_tells_variants_from_names():
    close, apart = X.jaro_winkler_value("gnanasekaran", "gnanasekeran"), X.jaro_winkler_value("ranatunga", "rathnayake")
    assert close > 0.88 > apart and close - apart > 0.15
    assert X.jaro_winkler_value("", "a") == 0 and X.jaro_winkler_value("a", "a") == 1


def test_roman_numbers(spark):
    d = spark.createDataFrame([("ii",), ("xiv",), ("abc",), ("",), ("iiii",)], "t string")
    assert [r[0] for r in d.select(X.roman_value(F.col("t"))).collect()] == [2, 14, None, None, None]


def test_vectors(spark):
    assert one(spark, V.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[2.0, 0.0]) == 1.0
    assert one(spark, V.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[2.0]) == 0.0
    assert one(spark, V.unit(F.col("a")), a=[3.0, 4.0]) == [0.6, 0.8]
    assert one(spark, V.unit(F.col("a")), a=[0.0, 0.0]) == [0.0, 0.0]
    d = spark.createDataFrame([([[1.0, 3.0], [3.0, 5.0]],)], "r array<array<double>>")
    assert d.select(V.mean_pooled(F.col("r"))).first()[0] == [2.0, 4.0]
    assert V.fnv1a("foo") == 2851307223
    e = V.hash_embedding(["river", "lantern"], 16)
    assert abs(float((e * e).sum()) - 1) < 1e-9
