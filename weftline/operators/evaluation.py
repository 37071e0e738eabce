"""Checking answers against their context, grading them, and rolling grades up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import contains_loosely, is_refusal, looks_factual, search_tokens, sentences

SUPPORT, QUOTE = 0.4, 220


def cited_sentences(answers: DataFrame, key: str = "answer_id", answer: str = "answer") -> DataFrame:
    """(key, n, sentence, marks, factual): sentences of each answer with the citation numbers in them."""
    split = answers.select(F.col(key), F.posexplode(sentences(F.col(answer))).alias("n", "sentence"))
    marks = F.transform(F.regexp_extract_all("sentence", F.lit(r"\[(\d{1,6})\]"), F.lit(1)), lambda x: x.cast("int"))
    return split.withColumn("marks", F.array_distinct(marks)).withColumn("factual", looks_factual(F.col("sentence")))


def checked_citations(answers: DataFrame, contexts: DataFrame, key: str = "answer_id") -> DataFrame:
    """(key, n, mark, chunk_id, overlap, quote, supported) for each cited factual sentence.

    ``contexts`` has (key, rank, chunk_id, text); mark k cites the chunk of rank k. The overlap is the
    largest share of the sentence's terms that one sentence of the chunk holds; 0.4 supports it. The
    quote is that sentence, cut at 220. A mark without a chunk supports nothing.
    """
    cited = cited_sentences(answers, key).where("factual").select(key, "n", search_tokens(F.regexp_replace("sentence", r"\[\d+\]", "")).alias("terms"), F.explode("marks").alias("mark"))
    cited = cited.withColumn("terms", F.array_distinct("terms"))
    held = cited.join(contexts.select(key, F.col("rank").alias("mark"), "chunk_id", sentences(F.col("text")).alias("parts")), [key, "mark"], "left")
    share = lambda s: F.size(F.array_intersect("terms", search_tokens(s))) / F.size("terms")
    best = F.array_max(F.transform("parts", lambda s, i: F.struct(F.when(F.size("terms") > 0, share(s)).otherwise(0.0).alias("o"), (-i).alias("i"), s.alias("s"))))
    out = held.withColumn("b", best)
    overlap = F.coalesce(F.col("b.o"), F.lit(0.0))
    quote = F.when(F.length("b.s") > QUOTE, F.concat(F.left("b.s", F.lit(QUOTE)), F.lit("…"))).otherwise(F.col("b.s"))
    return out.select(key, "n", "mark", "chunk_id", F.round(overlap, 6).alias("overlap"), F.when(overlap >= SUPPORT, quote).alias("quote"), (overlap >= SUPPORT).alias("supported"))


def groundedness(answers: DataFrame, contexts: DataFrame, key: str = "answer_id") -> DataFrame:
    """(key, factual, supported, groundedness): share of factual sentences that a citation supports; 1 without any, 0 without context or for a blank answer."""
    said = cited_sentences(answers, key).groupBy(key).agg(F.sum(F.col("factual").cast("int")).alias("factual"))
    good = checked_citations(answers, contexts, key).where("supported").groupBy(key).agg(F.countDistinct("n").alias("supported"))
    has = contexts.select(key).distinct().withColumn("has", F.lit(True))
    all_ = answers.groupBy(key).agg(F.max(F.coalesce(F.col("answer").rlike(r"\S"), F.lit(False))).alias("told")).join(said, key, "left").join(good, key, "left").join(has, key, "left")
    out = all_.select(key, F.coalesce("factual", F.lit(0)).alias("factual"), F.coalesce("supported", F.lit(0)).alias("supported"), "has", "told")
    ratio = F.when(F.col("has").isNull() | ~F.col("told"), 0.0).when(F.col("factual") == 0, 1.0).otherwise(F.round(F.col("supported") / F.col("factual"), 3))
    return out.select(key, "factual", "supported", ratio.alias("groundedness"))


def graded(responses: DataFrame, golden: DataFrame) -> DataFrame:
    """(question_id, type, stage, pass): responses (question_id, stage, answer, path) against golden rows.

    ``golden`` has (id, type, expected_contains, expected_path, expect_refusal); ``path`` is an array of
    names. A question that expects a refusal, or of type ungrounded, passes by refusing, but at stage 0 by answering; one of type
    path with an expected path if each expected name is part of a name of the path; any other
    if it is no refusal and every expected text stands in the answer, loosely. Where nothing is expected, nothing passes.
    """
    g = golden.select(F.col("id").alias("question_id"), "type", "expected_contains", "expected_path", (F.coalesce("expect_refusal", F.lit(False)) | (F.coalesce("type", F.lit("")) == "ungrounded")).alias("expect_refusal"))
    both = responses.join(g, "question_id")
    said = F.coalesce("answer", F.lit(""))
    refused = is_refusal(F.col("answer"))
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    on_path = F.forall("expected_path", lambda p: F.exists("path", lambda n: F.contains(F.lower(n), F.lower(p))))
    ok = (
        F.when(F.col("expect_refusal"), F.when(F.col("stage") == 0, ~refused & (said != "")).otherwise(refused))
        .when((F.col("type") == "path") & some("expected_path"), some("path") & on_path)
        .otherwise(~refused & some("expected_contains") & F.forall("expected_contains", lambda p: contains_loosely(said, p)))
    )
    return both.select("question_id", "type", "stage", F.coalesce(ok, F.lit(False)).alias("pass"))


def golden_subset(golden: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """The questions with these ids, all without a list."""
    return golden if ids is None else golden.where(F.col("id").isin(ids))


def recall(retrieved: DataFrame, expected: DataFrame) -> DataFrame:
    """(question_id, recall) for golden rows (question_id, expected_chunk_ids, expected_sections) and hits (question_id, chunk_id, section, text).

    The share of expected chunks that were retrieved; without any, the share of expected sections whose
    name stands in the section or text of a hit, whatever the case; without either, whether anything was retrieved.
    """
    want = expected.select("question_id", F.coalesce("expected_chunk_ids", F.array().cast("array<string>")).alias("ids"), F.coalesce("expected_sections", F.array().cast("array<string>")).alias("names"))
    by_id = want.select("question_id", F.explode("ids").alias("chunk_id"))
    ids = by_id.join(retrieved.select("question_id", "chunk_id", F.lit(1).alias("hit")).distinct(), ["question_id", "chunk_id"], "left").groupBy("question_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("by_id"))
    places = retrieved.select("question_id", F.lower(F.concat_ws("\u0000", "section", "text")).alias("place"))
    one = want.where("size(ids) = 0").select("question_id", F.explode(F.array_distinct("names")).alias("name"), F.size("names").alias("n"), "names")
    met = one.join(places, "question_id", "left").groupBy("question_id", "name", "n", "names").agg(F.max(F.coalesce(F.contains("place", F.lower("name")), F.lit(False)).cast("int")).alias("hit"))
    times = F.size(F.filter("names", lambda x: x == F.col("name")))
    names = met.groupBy("question_id").agg((F.sum(F.col("hit") * times) / F.max("n")).alias("by_name"))
    some = retrieved.select("question_id", F.lit(1.0).alias("any")).distinct()
    out = want.join(ids, "question_id", "left").join(names, "question_id", "left").join(some, "question_id", "left")
    return out.select("question_id", F.round(F.coalesce("by_id", "by_name", "any", F.lit(0.0)), 6).alias("recall"))


def pass_rates(cells: DataFrame, by: list[str], ok: str = "pass", digits: int = 3) -> DataFrame:
    """(by, n, pass_rate) with .NET-like rounding half to even."""
    return cells.groupBy(*by).agg(F.count("*").alias("n"), F.bround(F.avg(F.col(ok).cast("double")), digits).alias("pass_rate"))


def heatmap(cells: DataFrame, row: str, column: str, values: list, ok: str = "pass") -> DataFrame:
    """Pass rates with one column per value; the values are given, so no extra pass finds them."""
    return cells.groupBy(row).pivot(column, values).agg(F.bround(F.avg(F.col(ok).cast("double")), 3))


def regressions(cells: DataFrame, item: str, order: str, ok: str = "pass") -> DataFrame:
    """Rows that fail though the item passed the time before."""
    before = F.lag(ok).over(Window.partitionBy(item).orderBy(order))
    return cells.withColumn("before", before).where(F.col("before") & ~F.col(ok)).drop("before")


def rejection_rate(decisions: DataFrame, rejected: str) -> DataFrame:
    return decisions.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg(F.col(rejected).cast("double")), F.lit(0.0)), 6).alias("rejection_rate"))
