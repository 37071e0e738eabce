"""Keyword and vector retrieval, rank fusion, reranking and metadata filters, for batches of questions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from weftline.functions.text import basic_tokens, folded, is_search_token, query_tokens, raw_tokens, search_tokens, years_in
from weftline.functions.vectors import cosine, fused_score
from weftline.plans.runtime import cut_lineage

K1, B, RRF_K = 1.5, 0.75, 60
#: Distinct terms of a batch of questions up to which they are broadcast; beyond it they are joined by a shuffle.
BROADCAST_TERMS = 100_000
#: Distinct terms up to which they are written into the plan and looked for while the texts are read.
LITERAL_TERMS = 1_000
#: Scores that are held at once.
SCORES = 4_000_000
#: Query vectors up to which they are broadcast.
BROADCAST_QUERIES = 10_000
FILTER_FIELDS = ("year", "year_from", "year_to", "doctype", "subject", "studio")
#: Phrases of a question that point to a kind of document, most telling first.
DOCTYPE_HINTS = [
    ("box office", "box-office"), ("opening weekend", "box-office"), ("gross", "box-office"), ("cast announcement", "casting"), ("casting", "casting"), ("recast", "casting-history"),
    ("award", "awards-record"), ("won", "awards-record"), ("nominat", "awards-record"), ("episode", "episode-guide"), ("season", "series-record"), ("press kit", "press-kit"), ("synopsis", "press-kit"),
    ("biography", "talent-record"), ("filmography", "talent-record"), ("credits", "talent-record"), ("festival", "festival"),
]


@dataclass(frozen=True)
class MetadataFilter:
    """Equality on front matter, whatever the case; a part of the section's heading; a year or a span of years."""

    doctype: str | None = None
    subject: str | None = None
    studio: str | None = None
    market: str | None = None
    section: str | None = None
    year: int | None = None
    years: tuple[int, int] | None = None

    def condition(self) -> Column:
        """True for rows that meet every given field; a null field of a row meets none."""
        out = F.lit(True)
        for name in ("doctype", "subject", "studio", "market"):
            wanted = getattr(self, name)
            if wanted is not None:
                out = out & (F.lower(F.col(name)) == wanted.lower())
        if self.section is not None:
            out = out & F.contains(F.lower(F.col("section")), F.lit(self.section.lower()))
        if self.year is not None:
            out = out & (F.col("year") == self.year)
        if self.years is not None:
            out = out & F.col("year").between(*self.years)
        return F.coalesce(out, F.lit(False))

    def apply(self, rows: DataFrame) -> DataFrame:
        return rows.where(self.condition())


def term_rows(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, term) for every search token of every text; tokens are cut off and judged as rows, in compiled code."""
    found = texts.select(F.col(key), F.explode(raw_tokens(F.col(text))).alias("__t"))
    return found.select(key, F.rtrim("__t", F.lit(".,")).alias("term")).where(is_search_token(F.col("term")))


def postings(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, term, tf): search terms of each text with their counts; texts without terms have no rows."""
    return term_rows(texts, key, text).groupBy(key, "term").agg(F.count("*").alias("tf"))


def bm25(texts: DataFrame, questions: DataFrame, key: str = "id", text: str = "text", k1: float = K1, b: float = B, scopes: DataFrame | None = None) -> DataFrame:
    """(question_id, key, score) for texts that share a term with the question; scores above 0 only.

    ``questions`` has (question_id, question), ``texts`` one row per key. N, document frequencies and
    the mean length cover the texts given, so a filter applied before changes them. One pass over the
    texts counts, per text, its tokens and those of the questions' terms; only the latter are rows.
    With ``scopes`` (scope, key), each question sees the texts of its own ``scope`` only, and the
    figures are those of the scope.
    """
    asked = questions.select("question_id", *(["scope"] if scopes is not None else []), F.explode(query_tokens(F.col("question"))).alias("term"))
    wanted = asked.select("term").distinct().withColumn("asked", F.lit(True))
    small = wanted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS  # a batch of questions may be any size
    if scopes is not None:
        asked = cut_lineage(asked)
        held = F.broadcast if asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else lambda rows: rows  # terms of the questions, none of the texts
        texts = texts.join(scopes.select(key).distinct(), key, "left_semi")
    few = [r[0] for r in wanted.select("term").limit(LITERAL_TERMS + 1).collect()]
    if len(few) <= LITERAL_TERMS:  # counted where the text is read: only the questions' terms become rows
        tokens = texts.select(key, search_tokens(F.col(text)).alias("__ts"))
        per = tokens.select(key, F.size("__ts").alias("length"), F.explode_outer(F.filter("__ts", lambda t: t.isin(few))).alias("term"))
        per = cut_lineage(per.groupBy(key, "term").agg(F.sum(F.when(F.col("term").isNotNull(), 1).otherwise(0)).alias("tf"), F.first("length").alias("length")))
        tf = per.where("term is not null").select(key, "term", "tf", "length")
        sizes = per.groupBy(key).agg(F.first("length").alias("length")).where("length > 0")
    else:
        flagged = term_rows(texts, key, text).join(F.broadcast(wanted) if small else wanted, "term", "left")
        per = cut_lineage(flagged.groupBy(key, F.when(F.col("asked"), F.col("term")).alias("term")).agg(F.count("*").alias("tf")))
        whole = F.sum("tf").over(Window.partitionBy(key)).alias("length")
        tf = per.select(key, "term", "tf", whole).where("term is not null")
        sizes = per.groupBy(key).agg(F.sum("tf").alias("length"))
    if scopes is None:
        counted = sizes.agg(F.sum("length")).scalar()
        size = texts.agg(F.struct(F.count("*").alias("n"), F.count(text).alias("known"))).scalar()
        df = tf.groupBy("term").agg(F.count("*").alias("df"))
        scored = tf.join(asked, "term").join(df, "term").withColumn("size", size).withColumn("n", F.col("size.n")).withColumn("mean", counted / F.col("size.known"))
    else:
        known = texts.select(key, F.col(text).isNotNull().alias("known")).join(sizes, key, "left")
        size = scopes.join(known, key).groupBy("scope").agg(F.count("*").alias("n"), (F.sum("length") / F.count_if("known")).alias("mean"))
        inside = cut_lineage(tf.join(scopes, key).join(held(asked.select("scope", "term").distinct()), ["scope", "term"]))
        df = inside.groupBy("scope", "term").agg(F.count("*").alias("df"))
        weighed = inside.join(held(df), ["scope", "term"]).join(held(size.join(held(asked.select("scope").distinct()), "scope", "left_semi")), "scope")
        scored = weighed.join(held(asked), ["scope", "term"])
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return scored.groupBy("question_id", key).agg(F.sum(part).alias("score")).where("score > 0")


def top_k(scored: DataFrame, k: int, key: str = "id", by: str = "score", per: str = "question_id") -> DataFrame:
    """The k best rows per question with their rank; equal scores go to the smaller id."""
    rank = F.row_number().over(Window.partitionBy(per).orderBy(F.desc(by), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def vector_scores(vectors: DataFrame, queries: DataFrame, key: str = "id", salts: int = 256) -> DataFrame:
    """(question_id, key, score): cosine of each question's vector with every vector of the same width.

    A question set of up to ``BROADCAST_QUERIES`` is broadcast: the collection is read once and never
    shuffled. A larger one goes to every one of ``salts`` parts of the collection. For every vector
    against every other use an index.
    """
    q = queries.select("question_id", F.col("vector").alias("__q"), F.size("vector").alias("__w"))
    base = vectors.select(key, F.col("vector").alias("__v"), F.size("vector").alias("__w"))
    if q.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES:
        both = base.join(F.broadcast(q), "__w")
    else:
        part = F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")
        both = base.withColumn("__s", part).join(q.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["__w", "__s"])
    return both.select("question_id", key, cosine(F.col("__q"), F.col("__v")).alias("score"))


def _best_in_batches(asked: dict[int, dict], k: int, digits: int | None, kind: pa.DataType):
    """Per batch and question the k best rows; ``asked`` holds question ids and unit vectors by width and scope (None: all rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            sorted_ = np.argsort(np.array(batch.column(0).to_pylist(), dtype=object), kind="stable")
            for width, groups in asked.items():
                own = sorted_[sizes[sorted_] == width]
                rows = batch.take(pa.array(own))
                x = rows.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
                size = np.linalg.norm(x, axis=1)
                x = np.divide(x, size[:, None], out=np.zeros_like(x), where=size[:, None] > 0)
                within = _rows_of_scopes(rows.column(2)) if batch.num_columns > 2 else {None: np.arange(len(own))}
                parts = ((ids, q, within[scope][i : i + max(64, SCORES // len(ids))]) for scope, (ids, q) in groups.items() if scope in within for i in range(0, len(within[scope]), max(64, SCORES // len(ids))))
                for ids, q, sel in parts:
                    score = q @ x[sel].T
                    score = score if digits is None else np.round(score, digits) + 0.0
                    m = min(k, len(sel))
                    kth = np.partition(score, len(sel) - m, axis=1)[:, len(sel) - m]
                    at, hit = np.nonzero(score >= kth[:, None])
                    best = np.lexsort((np.arange(len(at)), -score[at, hit], at))
                    at, hit = at[best], hit[best]
                    kept = np.flatnonzero(np.arange(len(at)) - np.searchsorted(at, at) < m)
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in at[kept]], kind), rows.column(0).take(pa.array(sel[hit[kept]])), pa.array(score[at[kept], hit[kept]])], ["question_id", batch.schema.names[0], "score"])

    return run


def _rows_of_scopes(lists: pa.Array) -> dict:
    """Of each scope in the lists the places of its rows, ascending."""
    codes = lists.flatten().dictionary_encode()
    at = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    code = codes.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    cuts = np.searchsorted(code[order], np.arange(1, len(codes.dictionary)))
    return dict(zip(codes.dictionary.to_pylist(), np.split(at[order], cuts)))


def vector_top(vectors: DataFrame, queries: DataFrame, k: int, key: str = "id", digits: int | None = None, scopes: DataFrame | None = None) -> DataFrame:
    """(question_id, key, score, rank): the k vectors of largest cosine for each question; equal scores go to the smaller key.

    Up to ``BROADCAST_QUERIES`` questions are multiplied with parts of the collection and only the best k of a part
    go on, so rows do not grow with questions times vectors; more are scored by :func:`vector_scores`. Scores are rounded
    to ``digits`` before they are ranked. Nulls and other widths have no score, zero vectors 0; null keys are left out.
    With ``scopes`` (scope, key), each question meets the vectors of its own ``scope`` only.
    """
    scope = F.lit(None) if scopes is None else F.col("scope")
    asked = queries.where("vector is not null and question_id is not null").select("question_id", F.transform("vector", lambda x: x.cast("double")).alias("v"), scope.alias("scope")).where("size(v) > 0")
    rows = asked.limit(BROADCAST_QUERIES + 1).collect()
    base = vectors.where(F.col(key).isNotNull())
    if len(rows) > BROADCAST_QUERIES:
        scored = vector_scores(base, queries, key)
        if scopes is not None:
            scored = scored.join(queries.select("question_id", "scope"), "question_id").join(scopes, ["scope", key], "left_semi").drop("scope")
        return top_k(scored if digits is None else scored.withColumn("score", F.round("score", digits)), k, key)
    held: dict[int, dict] = {}
    for r in rows:
        ids, own = held.setdefault(len(r[1]), {}).setdefault(r[2], ([], []))
        ids.append(r[0])
        own.append(np.nan_to_num(np.array([x or 0.0 for x in r[1]])))
    sized = {w: {s: (ids, np.stack([v / (np.linalg.norm(v) or 1.0) for v in own])) for s, (ids, own) in by.items()} for w, by in held.items()}
    kinds = f"question_id {queries.schema['question_id'].dataType.simpleString()}, `{key}` {vectors.schema[key].dataType.simpleString()}, score double"
    base = base.select(key, "vector")
    if scopes is not None:
        base = base.join(scopes.groupBy(key).agg(F.collect_set("scope").alias("__scopes")), key)
    return top_k(base.mapInArrow(_best_in_batches(sized, k, digits, to_arrow_type(queries.schema["question_id"].dataType)), kinds), k, key)


def fuse(first: DataFrame, second: DataFrame, key: str = "id", k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked arms (question_id, key, rank): score, arm and both ranks.

    arm says where a row comes from: vector (first), keyword (second) or both.
    """
    a = first.select("question_id", key, F.col("rank").alias("vector_rank"))
    b = second.select("question_id", key, F.col("rank").alias("keyword_rank"))
    both = a.join(b, ["question_id", key], "full_outer")
    arm = F.when(F.col("vector_rank").isNull(), "keyword").when(F.col("keyword_rank").isNull(), "vector").otherwise("both")
    return both.withColumn("score", fused_score(F.col("vector_rank"), F.col("keyword_rank"), k=k)).withColumn("arm", arm)


def lexical_rerank(candidates: DataFrame, key: str = "id") -> DataFrame:
    """Candidates (question_id, question, key, text, rank) with a lexical score, the new rank and the change.

    Each distinct question token of three characters or more adds a saturated count, damped by the
    text's length against 180 tokens; the sum is weighted by half plus half the share of tokens found.
    """
    terms = F.filter(F.array_distinct(basic_tokens(folded(F.col("question")))), lambda t: F.length(t) > 2)
    got = candidates.withColumn("__q", terms).withColumn("__t", basic_tokens(folded(F.col("text"))))
    count = lambda t: F.size(F.filter("__t", lambda x: x == t)).cast("double")
    weight = 1.2 * (0.25 + 0.75 * F.size("__t") / 180.0)
    gained = F.aggregate(F.transform("__q", lambda t: count(t)), F.lit(0.0), lambda s, f: s + F.when(f > 0, f * 2.2 / (f + weight)).otherwise(0.0))
    matched = F.size(F.filter("__q", lambda t: F.array_contains("__t", t)))
    score = F.when(F.size("__q") > 0, gained * (0.5 + 0.5 * matched / F.size("__q"))).otherwise(0.0)
    order = Window.partitionBy("question_id").orderBy(F.desc("rerank_score"), "rank")
    done = got.withColumn("rerank_score", score).withColumn("rank_after", F.row_number().over(order)).withColumn("rank_change", F.col("rank") - F.col("rank_after"))
    return done.drop("__q", "__t")


def parts_named(q: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """(question_id, column): the distinct values of a column that stand, in lower case, in the lower-case question ``q`` (question_id, q).

    The parts of each question of the lengths that values have are joined to the values: the work grows with
    the questions, not with questions times values.
    """
    values = rows.where(F.length(column) > 0).select(column).distinct().withColumn("__part", F.lower(column))
    sizes = values.agg(F.collect_set(F.length("__part"))).scalar()
    cut = q.select("question_id", "q", F.explode(sizes).alias("__n")).where("__n <= length(q)")
    at = F.sequence(F.lit(1), F.length("q") - F.col("__n") + 1)
    parts = cut.select("question_id", F.explode(F.array_distinct(F.transform(at, lambda i: F.substring("q", i, F.col("__n"))))).alias("__part"))
    return parts.join(values, "__part").select("question_id", column)


def inferred_filters(questions: DataFrame, sections: DataFrame, hints: list[tuple[str, str]] | None = None) -> DataFrame:
    """(question_id, year, year_from, year_to, doctype, subject, studio) as the question's words suggest.

    One year asks for it, several for their span. The first hint phrase in the question whose document
    kind the collection has (by that name, else as a part of a name, else as a longer one) decides the
    kind; equal fits go to the smaller name. The longest subject and the first studio named in the
    question are taken; a year outside the known years of that subject is dropped.
    """
    low = F.lower("question")
    years = years_in(F.col("question"))
    q = questions.select("question_id", low.alias("q"), years.alias("ys"))
    base = q.select("question_id", F.when(F.size("ys") == 1, F.col("ys")[0]).alias("year"), F.when(F.size("ys") > 1, F.array_min("ys")).alias("year_from"), F.when(F.size("ys") > 1, F.array_max("ys")).alias("year_to"))
    told = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(p).alias("phrase"), F.lit(d).alias("wanted")) for i, (p, d) in enumerate(hints or DOCTYPE_HINTS)])
    own = F.lower("doctype")
    fit = lambda w: F.when(own == w, 0).when(F.contains(own, w), 1).when(F.contains(w, own), 2)
    kinds = sections.where("doctype is not null").select("doctype").distinct().select("doctype", F.explode(F.filter(told, lambda h: fit(h["wanted"]).isNotNull())).alias("h"))
    offered = kinds.select(F.col("h.place").alias("place"), fit(F.col("h.wanted")).alias("fit"), "doctype")
    asked = q.select("question_id", F.explode(F.filter(told, lambda h: F.contains("q", h["phrase"]))).alias("h")).select("question_id", F.col("h.place").alias("place"))
    kind = asked.join(offered, "place").groupBy("question_id").agg(F.min(F.struct("place", "fit", "doctype"))["doctype"].alias("doctype"))
    subject = parts_named(q, sections, "subject").groupBy("question_id").agg(F.max_by("subject", F.struct(F.length("subject"), "subject")).alias("subject"))
    studio = parts_named(q, sections, "studio").groupBy("question_id").agg(F.min("studio").alias("studio"))
    known = sections.where("year is not null").groupBy("subject").agg(F.collect_set("year").alias("known"))
    out = base.join(kind, "question_id", "left").join(subject, "question_id", "left").join(studio, "question_id", "left").join(known, "subject", "left")
    fits = F.col("known").isNull() | F.coalesce(F.array_contains("known", F.col("year")), F.lit(True))
    return out.select("question_id", F.when(fits, F.col("year")).alias("year"), "year_from", "year_to", "doctype", "subject", "studio")


def within_filters(filters: DataFrame, rows: DataFrame) -> DataFrame:
    """(scope, id): the rows (id, year, doctype, subject, studio) that meet each distinct filter of :func:`scoped`; a null field of a row meets none."""
    wanted = filters.select("scope", *[F.col(c).alias(f"__{c}") for c in FILTER_FIELDS]).distinct()
    fits = F.lit(True)
    for c in ("doctype", "subject", "studio"):
        fits = fits & (F.col(f"__{c}").isNull() | (F.lower(c) == F.lower(f"__{c}")))
    fits = fits & (F.col("__year").isNull() | (F.col("year") == F.col("__year")))
    fits = fits & (F.col("__year_from").isNull() | F.col("year").between(F.col("__year_from"), F.col("__year_to")))
    return rows.select("id", "year", "doctype", "subject", "studio").join(wanted, fits).select("scope", "id")


def scoped(filters: DataFrame) -> DataFrame:
    """Filters of :func:`inferred_filters` with a ``scope``, the same for equal filters."""
    return filters.withColumn("scope", F.to_json(F.struct(*FILTER_FIELDS)))


def page(rows: DataFrame, order: list[str], skip: int = 0, take: int = 50) -> DataFrame:
    """``take`` (1 to 500) rows after the first ``skip`` in the given order."""
    return rows.orderBy(*order).offset(max(0, skip)).limit(min(500, max(1, take)))


def payloads(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """What is stored beside a chunk's vector: the chunk's own fields and the heading of its section, twelve in all; chunks without a section have a null one."""
    named = chunks.join(sections.select(F.col("id").alias("section_id"), F.col("heading").alias("section")), "section_id", "left")
    return named.select(F.col("id").alias("chunk_id"), "doc_id", "section", "doctype", "subject", "year", "studio", "market", "page", "seq", "text", "entity_keys")


def retrieved(hits: DataFrame, payload: DataFrame) -> DataFrame:
    """Hits (question_id, chunk_id, rank, score) with the payload of their chunk; hits without one are left out."""
    return hits.select("question_id", "chunk_id", "rank", "score").join(payload, "chunk_id")


def newest(rows: DataFrame, by: str, key: str, limit: int | None = None) -> DataFrame:
    """Rows with the latest time first, ties by key; the first ``limit`` of them where one is given (lists of documents, of runs)."""
    ordered = rows.orderBy(F.desc(by), key)
    return ordered if limit is None else ordered.limit(limit)


def with_fallback(scored: DataFrame) -> DataFrame:
    """score from (question_id, lexical, model): the model's in 0..1, else half the lexical share of the question's best."""
    best = F.max("lexical").over(Window.partitionBy("question_id"))
    scaled = F.when(best > 0, F.col("lexical") / best * 0.5).otherwise(0.0)
    return scored.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("model", scaled))))
