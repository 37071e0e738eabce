"""A batch of questions through the stages of retrieval, lazy but for the few rows per question that several steps read."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.chunking import overlapping
from weftline.operators.graph import expand
from weftline.operators.search import bm25, fuse, inferred_filters, lexical_rerank, scoped, top_k, vector_top, within_filters
from weftline.plans.runtime import cut_lineage

#: Searches of one question at most, and the strategy whose chunks the graph was extracted from.
MOST_SEARCHES, GRAPH_STRATEGY = 4, "recursive"
#: Digits of a cosine that rank, so that equal vectors tie.
DIGITS = 12
#: Words of viewers and the words of press kits for them.
GLOSSARY = [
    (phrase, formal)
    for phrases, formal in (
        ("music/soundtrack/theme", "original score composed by composer"), ("filmed by/shot by/camera", "cinematographer director of photography"),
        ("the guy who made it/made by", "directed by director"), ("made money/earnings/took", "box office gross opening weekend domestic worldwide"),
        ("starred/was in/played in", "cast credited as principal role"), ("the studio behind it", "produced by distributed by production company"),
        ("episode where/the one where", "episode guide synopsis"), ("won/picked up", "award category nominated for ceremony"), ("writer/script", "screenplay by story by"),
    )
    for phrase in phrases.split("/")
]


@dataclass(frozen=True)
class AskOptions:
    """What a stage switches on. Values outside their range are brought back into it."""

    strategy: str = "fixed"
    metadata_filter: bool = False
    hybrid: bool = False
    rerank: bool = False
    rewrite: bool = False
    citations: bool = False
    agentic: bool = False
    graph: str = "none"
    router: bool = False
    top_k: int = 5
    candidate_k: int = 50
    max_hops: int = 6
    min_confidence: float = 0.6

    def normal(self) -> AskOptions:
        k = min(50, max(1, self.top_k))
        return replace(self, top_k=k, candidate_k=min(200, max(k, self.candidate_k)), max_hops=min(20, max(1, self.max_hops)), min_confidence=min(1.0, max(0.0, self.min_confidence)))


def stage_options(stage: int, base: AskOptions | None = None) -> AskOptions:
    """The cumulative options of stages 0 (no retrieval) to 11 (router)."""
    if not 0 <= stage <= 11:
        raise ValueError("stages run from 0 to 11")
    return replace(
        base or AskOptions(),
        strategy="none" if stage == 0 else "fixed" if stage == 1 else "recursive" if stage < 7 else "contextual",
        metadata_filter=stage >= 3, hybrid=stage >= 4, rerank=stage >= 5, rewrite=stage >= 6, citations=stage >= 8, agentic=stage >= 9,
        graph="expand" if stage >= 10 else "none", router=stage >= 11, candidate_k=(base or AskOptions()).candidate_k if stage >= 5 else (base or AskOptions()).top_k,
    ).normal()


#: What the router makes of a class of question: options that differ from the stage's.
ROUTES = {
    "lookup": {"agentic": False, "graph": "none"},
    "relational": {"graph": "expand", "agentic": False},
    "path": {"graph": "path", "agentic": False, "rerank": False, "hybrid": False},
    "aggregation": {"graph": "aggregate", "agentic": False},
    "multi_part": {"agentic": True, "graph": "expand"},
}


def routed(options: AskOptions, kind: str | None) -> AskOptions:
    """Options for a class of question, whatever its case; an unknown class counts as lookup, null (no answer of the router) changes nothing."""
    return replace(options, **ROUTES.get(kind.lower(), ROUTES["lookup"])) if options.router and kind is not None else options


def rewritten(questions: DataFrame, glossary: DataFrame) -> DataFrame:
    """Questions with the formal words for the colloquial ones in them added (glossary: phrase, expansion)."""
    hit = questions.join(glossary, F.contains(F.lower("question"), F.lower("phrase")))
    extra = hit.groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_set("expansion")), " ").alias("__x"))
    return questions.join(extra, "question_id", "left").withColumn("question", F.concat_ws(" ", "question", "__x")).drop("__x")


@dataclass(frozen=True)
class Inputs:
    """What the options beyond strategy, hybrid and rerank read; an option whose table is missing is an error.

    ``sections`` (doctype, subject, studio, year) and ``glossary`` (phrase, expansion) serve the filter
    and the rewriting, ``mentions`` (doc_id, chunk_id, entity_key) and ``edges`` the graph. ``searches``
    (question_id, iteration, question) and ``kinds`` (question_id, kind) are replayed answers of the
    planner and of the router; a question without them is searched once, with every layer left on.
    ``filters`` are those that ``search.scoped`` gives, if they are known already.
    """

    sections: DataFrame | None = None
    glossary: DataFrame | None = None
    mentions: DataFrame | None = None
    edges: DataFrame | None = None
    searches: DataFrame | None = None
    kinds: DataFrame | None = None
    filters: DataFrame | None = None

    def need(self, name: str) -> DataFrame:
        got = getattr(self, name)
        if got is None:
            raise ValueError(f"this stage needs {name}")
        return got


def retrieve(questions: DataFrame, chunks: DataFrame, vectors: DataFrame | None, options: AskOptions, inputs: Inputs = Inputs()) -> DataFrame:
    """(question_id, chunk_id, rank, score) for questions (question_id, question[, vector]).

    ``chunks`` has (id, strategy, text), for the filter also (year, doctype, subject, studio), for the
    graph (doc_id, strategy_ordinal, start_char, end_char). ``vectors`` is (id, vector). Without vectors
    the keyword arm alone ranks; without hybrid the vector arm alone. Candidates are narrowed to top_k
    after reranking; several searches are merged, and chunks reached through the graph (score null)
    follow last. A rewritten or planned text changes the words, the vector stays the question's.
    ``citations`` is a matter of the answers and changes no retrieval.
    """
    found = _Searches(questions, chunks, vectors, [options], inputs).hits()
    return found.select("question_id", "chunk_id", "rank", "score")


class _Searches:
    """Several sets of options for the same questions; what they have in common is computed once and kept in the checkpoint folder.

    Nothing that a question finds depends on the other questions. So one arm serves all options of a strategy and filter: the vector
    arm does not see the words, the keyword arm takes each wording of a question once, and fewer candidates are the first of more.
    """

    def __init__(self, questions: DataFrame, chunks: DataFrame, vectors: DataFrame | None, options: list[AskOptions], inputs: Inputs):
        self.chunks, self.vectors, self.inputs, self.kept = chunks, vectors, inputs, {}
        self.plans: list[tuple[int, str | None, bool, AskOptions]] = []  # the number of the options, a class of question, whether it counts, what runs
        q = questions
        options = [o.normal() for o in options]
        if inputs.kinds is not None and any(o.router for o in options):
            told = inputs.kinds.groupBy("question_id").agg(F.min("kind").alias("__kind"))
            known = F.when(F.lower("__kind").isin(list(ROUTES)), F.lower("__kind")).otherwise("lookup")
            q = q.join(told, "question_id", "left").withColumn("__kind", F.when(F.col("__kind").isNotNull(), known))
        if any(o.metadata_filter for o in options):
            filters = inputs.filters if inputs.filters is not None else scoped(inferred_filters(questions, inputs.need("sections")))
            number = F.dense_rank().over(Window.orderBy("scope"))  # one row per question: few
            self.filters = cut_lineage(filters.withColumn("scope", number))
            q = q.join(self.filters.select("question_id", "scope"), "question_id", "left")
        self.questions = cut_lineage(q)
        for i, o in enumerate(options):
            if o.router and inputs.kinds is not None:
                kinds = sorted((r[0] for r in self.questions.select("__kind").distinct().collect()), key=lambda k: k or "")
                self.plans += [(i, k, True, self.plain(routed(o, k))) for k in kinds]
            else:
                self.plans.append((i, None, False, self.plain(o)))

    def plain(self, o: AskOptions) -> AskOptions:
        """Options without what changes no chunk, so that equal ones are found."""
        return replace(o, citations=False, router=False, agentic=o.agentic, graph="expand" if o.graph == "expand" else "none", rewrite=o.rewrite and (o.hybrid or o.rerank or self.vectors is None), candidate_k=o.candidate_k if o.rerank or o.hybrid else o.top_k)

    def once(self, key: tuple, make) -> DataFrame:
        if key not in self.kept:
            self.kept[key] = cut_lineage(make())
        return self.kept[key]

    def own(self, o: AskOptions) -> DataFrame:
        return self.chunks.where(F.col("strategy") == o.strategy)

    def asked(self, o: AskOptions) -> DataFrame:
        """The searches of each question: question_id is (question_id, iteration)."""
        runs = self.questions.where("scope is not null") if o.metadata_filter else self.questions
        runs = rewritten(runs, self.inputs.need("glossary")) if o.rewrite else runs
        if o.agentic and self.inputs.searches is not None:
            planned = self.inputs.searches.where(F.col("iteration") <= MOST_SEARCHES).select("question_id", "iteration", F.col("question").alias("__planned"))
            runs = runs.join(planned, "question_id", "left").withColumn("question", F.coalesce("__planned", "question")).drop("__planned")
            runs = runs.withColumn("iteration", F.coalesce("iteration", F.lit(1)))
        else:
            runs = runs.withColumn("iteration", F.lit(1))
        return runs.withColumn("question_id", F.struct("question_id", "iteration")).drop("iteration")

    def wide(self, o: AskOptions) -> int:
        """Candidates that any of the options with the same strategy and filter needs."""
        return max(p.candidate_k for *_, p in self.plans if (p.strategy, p.metadata_filter) == (o.strategy, o.metadata_filter))

    def members(self, o: AskOptions) -> DataFrame | None:
        return self.once(("members", o.strategy), lambda: within_filters(self.filters, self.own(o))) if o.metadata_filter else None

    def near(self, o: AskOptions) -> DataFrame:
        """The vector arm: (question_id, id, score, rank), the id that of the question alone."""
        runs = self.questions.where("scope is not null") if o.metadata_filter else self.questions
        make = lambda: vector_top(self.vectors.join(self.own(o).select("id"), "id", "left_semi"), runs, self.wide(o), digits=DIGITS, scopes=self.members(o))
        return self.once(("near", o.strategy, o.metadata_filter), make)

    def keyword(self, o: AskOptions) -> DataFrame:
        """The keyword arm of the searches of these options: (question_id, id, score, rank)."""

        def make() -> DataFrame:
            wordings = sorted({(p.rewrite, p.agentic) for *_, p in self.plans if (p.strategy, p.metadata_filter) == (o.strategy, o.metadata_filter) and (p.hybrid or self.vectors is None)})
            told = [self.asked(replace(o, rewrite=r, agentic=g)).withColumn("question_id", F.struct(F.lit(r).alias("rewrite"), F.lit(g).alias("agentic"), F.col("question_id").alias("of"))) for r, g in wordings]
            same = ["question", *(["scope"] if o.metadata_filter else [])]  # many searches have the same words
            runs = cut_lineage(reduce(DataFrame.unionByName, told).select("question_id", *same, F.dense_rank().over(Window.orderBy(*same)).alias("n")))
            found = top_k(bm25(self.own(o), runs.select(F.col("n").alias("question_id"), *same).distinct(), scopes=self.members(o)), self.wide(o))
            return found.withColumnRenamed("question_id", "n").join(runs.select("n", "question_id"), "n").drop("n")

        all_ = self.once(("keyword", o.strategy, o.metadata_filter), make)
        return all_.where((F.col("question_id.rewrite") == o.rewrite) & (F.col("question_id.agentic") == o.agentic)).withColumn("question_id", F.col("question_id.of"))

    def ranked(self, o: AskOptions) -> DataFrame:
        """The top_k of every search: (question_id, id, rank, score)."""
        within = F.col("rank") <= o.candidate_k
        runs = self.asked(o)
        keyword = self.keyword(o).where(within) if o.hybrid or self.vectors is None else None
        ranked = keyword
        if self.vectors is not None:
            near = self.near(o).where(within).withColumnRenamed("question_id", "__q")
            near = near.join(runs.select("question_id"), F.col("__q") == F.col("question_id.question_id")).drop("__q")
            ranked = near if keyword is None else top_k(fuse(near, keyword), o.candidate_k)
        if o.rerank:
            texts = ranked.join(self.own(o).select("id", "text"), "id").join(runs.select("question_id", "question"), "question_id")
            ranked = lexical_rerank(texts).withColumn("rank", F.col("rank_after")).withColumn("score", F.col("rerank_score"))
        return ranked.where(F.col("rank") <= o.top_k).select("question_id", "id", "rank", "score")

    def merged(self, o: AskOptions) -> DataFrame:
        hits = self.ranked(o).select("question_id.question_id", "question_id.iteration", F.col("id").alias("chunk_id"), "rank", "score")
        if o.agentic:
            hits = merged_searches(hits).withColumn("rank", F.col("place"))
        return hits.select("question_id", "chunk_id", "rank", "score")

    def hits(self) -> DataFrame:
        """(options, question_id, chunk_id, rank, score) of every set of options, by its number."""
        found, grown = [], {}
        for i, kind, routed_, o in self.plans:
            got = self.once(("hits", replace(o, graph="none")), lambda: self.merged(o))  # noqa: B023
            if routed_:
                got = got.join(self.questions.where(F.col("__kind").eqNullSafe(kind)).select("question_id"), "question_id", "left_semi")
            got = got.select(F.lit(i).alias("options"), "question_id", "chunk_id", "rank", "score")
            found.append(got)
            if o.graph == "expand":
                grown.setdefault((o.strategy, o.min_confidence), (o, []))[1].append(got)
        for o, parts in grown.values():  # one walk for all options
            seeds = reduce(DataFrame.unionByName, parts).withColumn("question_id", F.struct("options", "question_id"))
            added = _through_graph(seeds.drop("options"), self.chunks, o, self.inputs)
            found.append(added.select("question_id.options", "question_id.question_id", "chunk_id", "rank", "score"))
        return reduce(DataFrame.unionByName, found)


def _through_graph(hits: DataFrame, chunks: DataFrame, o: AskOptions, inputs: Inputs) -> DataFrame:
    """What the graph adds to each question's chunks: of each, in order, the chunk before, the one after and three related ones.

    Chunks of another strategy than the graph's stand for the two of its strategy that they overlap most.
    """
    base = chunks.where(F.col("strategy") == GRAPH_STRATEGY)
    seeds = hits.select("question_id", F.col("chunk_id").alias("id"), "rank")
    if o.strategy == GRAPH_STRATEGY:
        mapped = seeds.select("question_id", F.col("id").alias("chunk_id"), "rank", F.lit(1).alias("near"))
    else:
        spans = chunks.join(seeds.select("id").distinct(), "id", "left_semi")
        near = overlapping(spans, base, 2).select("id", F.col("other").alias("chunk_id"), F.col("rank").alias("near"))
        mapped = cut_lineage(seeds.join(near, "id").drop("id"))
    met = expand(mapped.select("chunk_id"), base, inputs.need("mentions"), inputs.need("edges"), o.min_confidence)
    related = F.slice(F.split(F.coalesce("related_ids", F.lit("")), " "), 1, 3)
    added = F.concat(F.array("previous_id", "next_id"), related)
    rows = mapped.join(met.select("chunk_id", added.alias("added")), "chunk_id").select("question_id", "rank", "near", F.posexplode("added").alias("place", "chunk_id"))
    rows = rows.where("chunk_id is not null and chunk_id <> ''").join(hits.select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_anti")
    first = rows.groupBy("question_id", "chunk_id").agg(F.min(F.struct("rank", "near", "place")).alias("at"))
    order = F.row_number().over(Window.partitionBy("question_id").orderBy("at", "chunk_id"))
    last = hits.groupBy("question_id").agg(F.max("rank").alias("last"))
    return first.join(last, "question_id").select("question_id", "chunk_id", (F.col("last") + order).alias("rank"), F.lit(None).cast("double").alias("score"))


def compare(questions: DataFrame, chunks: DataFrame, vectors: DataFrame | None, stages: list[int], inputs: Inputs = Inputs()) -> DataFrame:
    """Every question at several stages: (stage, question_id, chunk_id, rank); what stages have in common is computed once."""
    found = _Searches(questions, chunks, vectors, [stage_options(s) for s in stages], inputs).hits()
    stage = F.element_at(F.array(*map(F.lit, stages)), F.col("options") + 1).alias("stage")
    return found.select(stage, "question_id", "chunk_id", "rank")


def merged_searches(results: DataFrame) -> DataFrame:
    """The union of several searches per question (question_id, iteration, chunk_id, rank): the first finding of a chunk stays."""
    first = Window.partitionBy("question_id", "chunk_id").orderBy("iteration", "rank")
    once = results.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("iteration", "rank", "chunk_id")))


def prompts(questions: DataFrame, contexts: DataFrame, system: str) -> DataFrame:
    """(question_id, prompt): numbered passages in rank order below the instructions, the question last."""
    passage = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("text"))
    told = contexts.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", passage.alias("p")))), lambda x: x["p"]), "\n\n").alias("context"))
    both = questions.join(told, "question_id", "left")
    return both.select("question_id", F.concat(F.lit(f"### system\n{system}\n\n### user\nCONTEXT\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQUESTION\n"), F.col("question")).alias("prompt"))


def cached_answers(requests: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Requests with the cached answer of the same key, and whether there was one; answers that failed are never served."""
    from weftline.functions.text import content_key

    usable = cache.where(~F.coalesce(F.contains(F.lower("warning"), F.lit("failed")), F.lit(False))).dropDuplicates(["key"])
    keyed = requests.withColumn("key", F.left(content_key(*[F.col(k) for k in keys]), F.lit(24)))
    return keyed.join(usable.select("key", "answer"), "key", "left").withColumn("cached", F.col("answer").isNotNull())
