"""The engine's own queries over the test tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.functions.vectors import hash_embedder
from weftline.operators import chunking, evaluation, extraction, graph, resolve, search
from weftline.plans import ask
from weftline.plans.runtime import table
from weftline.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
#: The questions of every hundredth answer, each with a vector of the embeddings.
Q_SQL = r"""(select question_id, regexp_replace(case when len(q) > 1 then q[-1] else u[-1] end, '^\s+|\s+$', '', 'g') as question, question_id % 500 as vec_id
from (select distinct answer_id as question_id, string_split_regex(p, '(?m)^[ \t]*QUESTION[ \t]*$') as q, string_split_regex(p, '(?m)^[ \t]*### user[ \t]*$') as u from (select answer_id, replace(replace(prompt, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as p from generated_answers where answer_id % 100 = 0))) as t"""


def tokens_sql(column: str) -> str:
    found = rf"list_transform(regexp_extract_all(lower({column}), '(?:\$[\p{{Nd}}.,]*|\p{{Nd}}[\p{{Nd}}.,]*)\p{{L}}*|\p{{L}}[\p{{L}}\p{{Nd}}'']*'), lambda x: regexp_replace(x, '[.,]+$', ''))"
    return rf"list_filter({found}, lambda x: length(x) > 0 and (regexp_matches(x, '^[$\p{{Nd}}]') or (length(x) > 1 and not list_contains([{STOP}], x))))"


def basic_sql(column: str) -> str:
    return f"regexp_extract_all(lower(strip_accents({column})), '{X.BASIC_TOKEN}')"


def distinct_list_sql(column: str) -> str:
    return f"list_filter({column}, lambda x, i: list_position({column}, x) = i)"


def level_sql(column: str) -> str:
    return rf"trim(regexp_replace(lower(translate({column}, '‘’“”–—‑ ', '''''\"\"--- ')), '\s+', ' ', 'g'))".replace('\\"', '"')


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def questions(spark: SparkSession, d: str, every: int = 100) -> DataFrame:
    """(question_id, question, vec_id) of the answers whose id is divisible by ``every``."""
    asked = table(spark, d, "generated_answers").where(F.col("answer_id") % every == 0)
    return asked.select(F.col("answer_id").alias("question_id"), X.question_part(F.col("prompt")).alias("question"), (F.col("answer_id") % 500).alias("vec_id")).distinct()


def chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "chunks").select("id", *columns).distinct()


CHUNKS = "(select distinct * from chunks)"

# Chunks and text


@query("""select doc_id, row_number() over (partition by doc_id order by i) - 1 as ordinal, i * 1600 as start_char, least((i + 1) * 1600, length(text)) as end_char, substring(text, (i * 1600 + 1)::bigint, 1600) as text
from (select doc_id, text, unnest(range(0, ((length(text) - 1) // 1600) + 1)) as i from documents where length(text) > 0) where regexp_matches(substring(text, (i * 1600 + 1)::bigint, 1600), '\\S')""")
def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.fixed_chunks(table(spark, d, "documents"), "doc_id")


@query()
def recursive_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.recursive_chunks(table(spark, d, "sections").select("id", "text").distinct())


@query("select doc_id, ceil(length(text) / 4.0)::int as tokens from documents")
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query(f"select term, count(distinct doc_id) as df, count(*) as tf from (select doc_id, unnest({tokens_sql('text')}) as term from documents) group by term")
def term_statistics(spark: SparkSession, d: str) -> DataFrame:
    return search.postings(table(spark, d, "documents"), "doc_id").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


BM25 = f"""asked as (select question_id, unnest({distinct_list_sql('ts')}[1:24]) as term from (select question_id, {tokens_sql('question')} as ts from {Q_SQL})),
toks as (select id, {tokens_sql('text')} as ts from src), size as (select count(*) as n, avg(len(ts)) as mean from toks),
tf as (select id, term, count(*) as tf, any_value(l) as l from (select id, len(ts) as l, unnest(ts) as term from toks) group by id, term), df as (select term, count(*) as df from tf group by term),
bm as (select question_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / mean))) as score from asked join tf using (term) join df using (term), size group by question_id, id)"""


@query(f"""with src as (select doc_id as id, text from documents), {BM25}
select question_id, id as doc_id, rank, round(score, 6) as score from (select *, row_number() over (partition by question_id order by round(score, 6) desc, id) as rank from bm) where rank <= 10""")
def bm25_top(spark: SparkSession, d: str, every: int = 100) -> DataFrame:
    scored = search.bm25(table(spark, d, "documents"), questions(spark, d, every), "doc_id").withColumn("score", F.round("score", 6))
    return search.top_k(scored, 10, "doc_id").select("question_id", "doc_id", "rank", "score")


@query("""select q.vec_id as question_id, e.vec_id, rank, score from (select a.vec_id as qid, b.vec_id as bid, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score,
row_number() over (partition by a.vec_id order by round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) desc, b.vec_id) as rank from embeddings a, embeddings b where a.vec_id % 100 = 0) s
join embeddings q on q.vec_id = qid join embeddings e on e.vec_id = bid where rank <= 10""")
def vector_top(spark: SparkSession, d: str) -> DataFrame:
    every = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = every.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "question_id")
    return search.vector_top(every, asked, 10, "vec_id", 6).select("question_id", "vec_id", "rank", "score")


HYBRID = f"""src as (select distinct id, text from chunks where strategy = 'recursive'), {BM25},
kw as (select question_id, id, row_number() over (partition by question_id order by round(score, 6) desc, id) as r from bm),
vec as (select distinct chunk_id as id, vector from vectors where vector is not null and chunk_id in (select id from src)),
vs as (select question_id, id, round(coalesce(case when isnan(list_cosine_similarity(e.embedding::double[], vector::double[])) then 0 else list_cosine_similarity(e.embedding::double[], vector::double[]) end, 0), 6) as score from {Q_SQL} join embeddings e using (vec_id), vec),
va as (select question_id, id, row_number() over (partition by question_id order by score desc, id) as r from vs),
fused as (select question_id, id, coalesce(1.0 / (60 + va.r), 0) + coalesce(1.0 / (60 + kw.r), 0) as score, case when va.r is null then 'keyword' when kw.r is null then 'vector' else 'both' end as arm, va.r as vector_rank, kw.r as keyword_rank
from (select * from va where r <= 50) va full join (select * from kw where r <= 50) kw using (question_id, id))"""


def arms(spark: SparkSession, d: str, wide: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    own = chunks(spark, d, "strategy", "text").where("strategy = 'recursive'")
    asked = questions(spark, d).join(table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector")), "vec_id")
    vectors = table(spark, d, "vectors").where("vector is not null").select(F.col("chunk_id").alias("id"), "vector").distinct().join(own.select("id"), "id", "left_semi")
    near = search.vector_top(vectors, asked, wide, digits=6)
    word = search.top_k(search.bm25(own, questions(spark, d)).withColumn("score", F.round("score", 6)), wide)
    return own, near, word


@query(f"with {HYBRID} select question_id, id, arm, vector_rank, keyword_rank, rank, round(score, 6) as score from (select *, row_number() over (partition by question_id order by score desc, id) as rank from fused) where rank <= 20")
def hybrid_fusion(spark: SparkSession, d: str) -> DataFrame:
    _, near, word = arms(spark, d)
    top = search.top_k(search.fuse(near, word), 20)
    return top.select("question_id", "id", "arm", "vector_rank", "keyword_rank", "rank", F.round("score", 6).alias("score"))


@query(f"""with {HYBRID}, cand as (select question_id, question, id, row_number() over (partition by question_id order by score desc, id) as rank from fused join {Q_SQL} using (question_id)),
t as (select c.*, list_filter({distinct_list_sql(basic_sql('question'))}, lambda x: length(x) > 2) as qs, {basic_sql('text')} as ts from cand c join src using (id) where rank <= 20),
f as (select question_id, id, rank, len(qs) as nq, list_sum(list_transform(qs, lambda q: len(list_filter(ts, lambda x: x = q)) * 2.2 / (len(list_filter(ts, lambda x: x = q)) + 1.2 * (0.25 + 0.75 * len(ts) / 180.0)))) as gained, len(list_filter(qs, lambda q: list_contains(ts, q))) as matched from t)
select question_id, id, rank, rank_after, rank - rank_after as rank_change, rerank_score from (select *, row_number() over (partition by question_id order by rerank_score desc, rank) as rank_after from (select *, round(case when nq > 0 then gained * (0.5 + 0.5 * matched / nq) else 0 end, 6) as rerank_score from f))""")
def lexical_rerank(spark: SparkSession, d: str) -> DataFrame:
    own, near, word = arms(spark, d)
    top = search.top_k(search.fuse(near, word), 20).select("question_id", "id", "rank").join(own.select("id", "text"), "id").join(questions(spark, d).select("question_id", "question"), "question_id")
    done = search.lexical_rerank(top).withColumn("rerank_score", F.round("rerank_score", 6))
    again = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("rerank_score"), "rank"))
    done = done.withColumn("rank_after", again)
    return done.select("question_id", "id", "rank", "rank_after", (F.col("rank") - F.col("rank_after")).alias("rank_change"), "rerank_score")


@query("select distinct id, heading, doctype, year from sections where lower(doctype) = 'title-record' and year between 1990 and 2010 and contains(lower(heading), 'the')")
def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    wanted = search.MetadataFilter(doctype="Title-Record", section="THE", years=(1990, 2010))
    return wanted.apply(table(spark, d, "sections").withColumn("section", F.col("heading"))).select("id", "heading", "doctype", "year").distinct()


HINTS = ", ".join(f"({i}, '{p}', '{k}')" for i, (p, k) in enumerate(search.DOCTYPE_HINTS))


@query(rf"""with q as (select question_id, lower(question) as q, list_sort(list_distinct(list_transform(regexp_extract_all(question, '\b(1[89]\d{{2}}|20\d{{2}})\b'), lambda y: y::int))) as ys from {Q_SQL}),
kind as (select question_id, first(doctype order by place, case when lower(doctype) = wanted then 0 when contains(lower(doctype), wanted) then 1 else 2 end, doctype) as doctype from q, (values {HINTS}) as h(place, phrase, wanted), (select distinct doctype from sections where doctype is not null) s
where contains(q, phrase) and (contains(lower(doctype), wanted) or contains(wanted, lower(doctype))) group by question_id),
subj as (select question_id, first(subject order by length(subject) desc, subject desc) as subject from q, (select distinct subject from sections where length(subject) > 0) where contains(q, lower(subject)) group by question_id),
stud as (select question_id, min(studio) as studio from q, (select distinct studio from sections where length(studio) > 0) where contains(q, lower(studio)) group by question_id),
known as (select subject, list(distinct year) as known from sections where year is not null group by subject)
select question_id, case when len(ys) = 1 and (known is null or list_contains(known, ys[1])) then ys[1] end as year, case when len(ys) > 1 then ys[1] end as year_from, case when len(ys) > 1 then ys[-1] end as year_to, doctype, subject, studio
from q left join kind using (question_id) left join subj using (question_id) left join stud using (question_id) left join known using (subject)""")
def filter_inference(spark: SparkSession, d: str) -> DataFrame:
    return search.inferred_filters(questions(spark, d), table(spark, d, "sections"))


@query(f"select id, doc_id, seq from {CHUNKS} where strategy = 'recursive' order by doc_id, seq limit 50 offset 100")
def chunk_page(spark: SparkSession, d: str) -> DataFrame:
    return search.page(chunks(spark, d, "doc_id", "seq", "strategy").where("strategy = 'recursive'"), ["doc_id", "seq"], 100, 50).select("id", "doc_id", "seq")


@query(f"select doc_id, strategy, count(*) as n from {CHUNKS} group by doc_id, strategy")
def chunks_per_strategy(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d, "doc_id", "strategy").groupBy("doc_id", "strategy").agg(F.count("*").alias("n"))


@query(f"""select id, lag(id) over w as previous_id, lead(id) over w as next_id, right(lag(raw_text) over w, 200) as tail from {CHUNKS} window w as (partition by doc_id, strategy order by strategy_ordinal, id)""")
def next_chain(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("doc_id", "strategy").orderBy("strategy_ordinal", "id")
    rows = chunks(spark, d, "doc_id", "strategy", "strategy_ordinal", F.right("raw_text", F.lit(200)).alias("own_tail"))
    return rows.select("id", F.lag("id").over(order).alias("previous_id"), F.lead("id").over(order).alias("next_id"), F.lag("own_tail").over(order).alias("tail"))


@query(f"""with a as (select distinct doc_id, id, start_char, end_char from chunks where strategy = 'fixed'), b as (select distinct doc_id, id, start_char, end_char from chunks where strategy = 'recursive')
select doc_id, id, other, overlap, rank from (select a.doc_id, a.id, b.id as other, least(a.end_char, b.end_char) - greatest(a.start_char, b.start_char) as overlap,
row_number() over (partition by a.doc_id, a.id order by least(a.end_char, b.end_char) - greatest(a.start_char, b.start_char) desc, b.start_char, b.id) as rank from a join b on a.doc_id = b.doc_id and a.start_char < b.end_char and a.end_char > b.start_char) where rank <= 2""")
def span_mapping(spark: SparkSession, d: str) -> DataFrame:
    rows = chunks(spark, d, "doc_id", "strategy", "start_char", "end_char")
    return chunking.overlapping(rows.where("strategy = 'fixed'"), rows.where("strategy = 'recursive'"), 2)


@query(f"""with n as (select doc_id, id, row_number() over (partition by doc_id order by seq) - 1 as i, count(*) over (partition by doc_id) as n from {CHUNKS} where strategy = 'fixed')
select doc_id, id from n where n <= 12 or i in (select (k * n.n) // 12 from range(12) r(k))""")
def spread_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.spread(chunks(spark, d, "doc_id", "seq", "strategy").where("strategy = 'fixed'"), 12, "seq", "doc_id").select("doc_id", "id")


@query("select distinct id, sha256(concat_ws('|', 'model', text)) as hash from chunks")
def content_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("id", X.content_key(F.lit("model"), F.col("text")).alias("hash")).distinct()


@query("""select distinct id, concat(coalesce(subject, 'Unknown subject'), ' (', coalesce(year::varchar, 'year unknown'), ', ', coalesce(doctype, 'document'), ') — ',
coalesce(summary, concat_ws(' ', heading, 'about ' || subject, '(' || year::varchar || ')', '[' || doctype || ']')), ' ') as prefix from sections""")
def contextual_prefixes(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    told = F.coalesce(c("summary"), X.section_summary(c("heading"), c("subject"), c("year"), c("doctype")))
    return table(spark, d, "sections").select("id", X.context_prefix(c("subject"), c("year"), c("doctype"), told).alias("prefix")).distinct()


@query(r"""select doc_id, count(*) as sentences, max(length(s)) as longest from (select doc_id, regexp_replace(unnest(regexp_extract_all(text, '(?:[^.!?\n]|\.\p{Nd})*[.!?\n]?')), '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g') as s from documents) where s <> '' group by doc_id""")
def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "documents").select("doc_id", F.explode(X.sentences(F.col("text"))).alias("s"))
    return parts.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.max(F.length("s")).alias("longest"))


@query()
def markdown_lines(spark: SparkSession, d: str) -> DataFrame:
    flat = files.flattened_markdown(table(spark, d, "documents"))
    return flat.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


@query()
def section_lines(spark: SparkSession, d: str) -> DataFrame:
    """Sections cut again out of the archive's texts, each document one flow of lines."""
    rows = table(spark, d, "sections").select("doc_id", "ordinal", "page", "heading", "text").distinct()
    body = F.concat_ws("\n", F.concat(F.lit("### "), F.col("heading")), "text")
    lines = rows.select("doc_id", "ordinal", "page", F.posexplode(F.split(F.regexp_replace(body, "\r\n?", "\n"), "\n")).alias("i", "text"))
    flow = lines.select("doc_id", (F.col("ordinal").cast("bigint") * 100000 + F.col("i")).alias("n"), "page", "text", F.lit(10.0).alias("font_size"), F.lit(False).alias("bold"))
    return chunking.sections(flow)


@query()
def hash_embeddings(spark: SparkSession, d: str) -> DataFrame:
    embed = hash_embedder(64)
    return table(spark, d, "documents").select("doc_id", embed(X.basic_tokens(X.folded(F.coalesce("text", F.lit(""))))).alias("vector"))


# Names and grounding


@query(f"""with m as (select distinct c.id, c.doc_id, unnest(entity_keys) as key, text from chunks c), e as (select distinct doc_id, key, name from graph_entities where name is not null)
select distinct id, key, length({level_sql('name')}) >= 3 and contains({level_sql('text')}, {level_sql('name')}) as grounded from m join e using (doc_id, key)""")
def grounded_mentions(spark: SparkSession, d: str) -> DataFrame:
    held = chunks(spark, d, "doc_id", "text", "entity_keys").select("id", "doc_id", "text", F.explode(F.array_distinct("entity_keys")).alias("key"))
    names = table(spark, d, "graph_entities").where("name is not null").select("doc_id", "key", "name").distinct()
    return held.join(names, ["doc_id", "key"]).select("id", "key", X.is_grounded(F.col("name"), F.col("text")).alias("grounded")).distinct()


@query(rf"""select distinct doc_id, key, trim(regexp_replace(lower(strip_accents(name)), '(\s+({'|'.join(X.STUDIO_WORDS)})[.,]*)+$', '')) as studio from graph_entities where type = 'Studio' and name is not null""")
def studio_names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "graph_entities").where("type = 'Studio' and name is not null")
    return rows.select("doc_id", "key", X.normal_studio(X.folded(F.col("name"))).alias("studio")).distinct()


@query(r"""select distinct doc_id, key, trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', '-', 'g'), '-') as slug from graph_entities where name is not null""")
def entity_slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_entities").where("name is not null").select("doc_id", "key", X.slug(X.folded(F.col("name"))).alias("slug")).distinct()


@query("select lower(trim(name)) as name, array_to_string(list_sort(list(distinct type)), ' ') as types from graph_entities group by lower(trim(name)) having count(distinct type) > 1")
def names_of_several_types(spark: SparkSession, d: str) -> DataFrame:
    return resolve.names_of_several_types(table(spark, d, "graph_entities")).select("name", F.array_join("types", " ").alias("types"))


@query("""select key, sum(mentions)::bigint as mentions, min(year) as year, count(*) as documents from (select distinct doc_id, key, mentions, year from graph_entities) group by key""")
def entities_across_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "graph_entities").select("doc_id", "key", "mentions", "year").distinct().withColumnRenamed("doc_id", "chunk_id")
    return extraction.merged_entities(rows).select("key", "mentions", "year", F.size("chunk_ids").cast("bigint").alias("documents"))


@query("select doc_id, key, count(*) as count from graph_entities group by doc_id, key having count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return graph.duplicate_keys(table(spark, d, "graph_entities"))


@query("select distinct doc_id, key, name, mentions from graph_entities where type = 'Film' and contains(lower(name), 'the') order by mentions desc, lower(name), doc_id, key limit 100")
def entity_search(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "graph_entities").select("doc_id", "key", "type", "name", "mentions").distinct()
    return graph.find_entities(rows, "film", "THE").select("doc_id", "key", "name", "mentions")


@query("""select decision, count(*) as n, sum(self::int) as self_pairs from (select distinct doc_id, left_key, right_key, coalesce(lower(trim(decision)), '') as decision, left_key = right_key as self from merge_decisions) group by decision""")
def decision_tally(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "merge_decisions").select("doc_id", "left_key", "right_key", F.coalesce(F.lower(F.trim("decision")), F.lit("")).alias("decision")).distinct()
    return rows.groupBy("decision").agg(F.count("*").alias("n"), F.sum((F.col("left_key") == F.col("right_key")).cast("int")).cast("bigint").alias("self_pairs"))


@query(r"""with f as (select distinct doc_id, key, lower(strip_accents(name)) as t from graph_entities where type in ('Film', 'TVSeries') and name is not null),
b as (select *, regexp_replace(regexp_replace(t, '^\s*(.*?),\s*(the|a|an)\s*$', '\1'), '^(the|a|an) ', '') as b from f),
n as (select *, regexp_extract(b, '\b(part|chapter|volume|vol\.?)\s+([ivxlc]+)\b', 2) as r from b),
v as (select n.*, m.v from n left join (values ('i', '1'), ('ii', '2'), ('iii', '3'), ('iv', '4'), ('v', '5'), ('vi', '6'), ('vii', '7'), ('viii', '8'), ('ix', '9'), ('x', '10')) m(r, v) using (r))
select distinct doc_id, key, trim(regexp_replace(regexp_replace(case when v is null then b else regexp_replace(b, '\b(part|chapter|volume|vol\.?)\s+([ivxlc]+)\b', '\1 ' || v) end, '[:–—-]+', ' ', 'g'), '\s+', ' ', 'g')) as title from v""")
def title_forms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "graph_entities").where("type in ('Film', 'TVSeries') and name is not null")
    return rows.select("doc_id", "key", X.normal_title(X.folded(F.col("name"))).alias("title")).distinct()


@query("select distinct chunk_id, payload->>'$.docId' as doc_id, (payload->>'$.page')::int as page, (payload->>'$.seq')::int as seq from vectors")
def vector_payloads(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "vectors").select("chunk_id", F.from_json("payload", "docId string, page int, seq int").alias("p"))
    return rows.select("chunk_id", F.col("p.docId").alias("doc_id"), "p.page", "p.seq").distinct()


@query(f"""with t as (select doc_id, len({tokens_sql('text')}) as n from documents) select doc_id, (i * 190)::int as start, least(i * 190 + 254, n)::int as "end" from t, lateral (select unnest(range(0, case when n <= 254 then 1 else ceil((n - 254) / 190.0)::bigint + 1 end)) as i) where n > 0""")
def token_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", X.search_tokens(F.col("text")).alias("tokens"))
    return chunking.token_windows(rows).select("doc_id", "start", "end")


@query(r"""with p as (select distinct doc_id, key, string_split(trim(regexp_replace(regexp_replace(lower(strip_accents(name)), '[^\p{L}\p{Nd}.\s]', ' ', 'g'), '\s+', ' ', 'g')), ' ') as raw from graph_entities where type = 'Person' and name is not null),
t as (select doc_id, key, list_transform(list_filter(raw, lambda w: not list_contains(['jr', 'sr', 'ii', 'iii', 'iv'], regexp_replace(w, '\.$', ''))), lambda w: replace(w, '.', '')) as w from p)
select a.doc_id, a.key as left_key, b.key as right_key from t a join t b on a.doc_id = b.doc_id and a.key < b.key and len(a.w) = len(b.w) and len(a.w) >= 2 and a.w[-1] = b.w[-1]
where len(list_filter(range(1, len(a.w)), lambda i: not (a.w[i] = b.w[i] or (length(a.w[i]) = 1 and starts_with(b.w[i], a.w[i])) or (length(b.w[i]) = 1 and starts_with(a.w[i], b.w[i]))))) = 0 and len(list_filter(range(1, len(a.w)), lambda i: a.w[i] <> b.w[i])) > 0""")
def initials_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "graph_entities").where("type = 'Person' and name is not null").select("doc_id", "key", X.normal_person(X.folded(F.col("name")), {}).alias("n")).distinct()
    rows = rows.withColumn("last", F.element_at(F.split(F.replace("n", F.lit("."), F.lit("")), " "), -1))
    both = rows.alias("a").join(rows.alias("b"), (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.last") == F.col("b.last")) & (F.col("a.key") < F.col("b.key")))
    return both.where(X.initials_agree(F.col("a.n"), F.col("b.n"))).select("a.doc_id", F.col("a.key").alias("left_key"), F.col("b.key").alias("right_key"))


@query("select lower(trim(status)) as status, count(*) as n, min(uploaded_utc) as first_upload from (select distinct * from dossiers) group by lower(trim(status))")
def dossier_states(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dossiers").distinct().groupBy(F.lower(F.trim("status")).alias("status")).agg(F.count("*").alias("n"), F.min("uploaded_utc").alias("first_upload"))


# Graph over the star schema: parts are works, suppliers studios, customers persons

EDGES = """made as (select 'all' as doc_id, 'part:' || l_partkey as subject, 'PRODUCED_BY' as predicate, 'supplier:' || l_suppkey as object, count(*) as mentions, round(1 - min(l_discount), 2) as confidence from lineitem group by l_partkey, l_suppkey),
acted as (select 'all' as doc_id, 'customer:' || o_custkey as subject, 'ACTED_IN' as predicate, 'part:' || l_partkey as object, count(*) as mentions, round(1 - min(l_discount), 2) as confidence from lineitem join orders on l_orderkey = o_orderkey group by o_custkey, l_partkey),
brand as (select 'all' as doc_id, 'part:' || p_partkey as subject, 'PART_OF_FRANCHISE' as predicate, 'brand:' || p_brand as object, 1 as mentions, 1.0 as confidence from part),
won as (select 'all' as doc_id, 'part:' || l_partkey as subject, 'WON' as predicate, 'award:' || l_orderkey as object, count(*) as mentions, round(1 - min(l_discount), 2) as confidence from lineitem where l_returnflag = 'R' group by l_partkey, l_orderkey)"""


def star_edges(spark: SparkSession, d: str, kind: str, by: str | None = None) -> DataFrame:
    """Edges of one kind: made, acted, brand or won; with ``by`` (subject or object) dealt by that end, so what groups by it shuffles no more."""
    tag = lambda prefix, c: F.concat(F.lit(prefix + ":"), F.col(c).cast("string"))
    lines = table(spark, d, "lineitem")
    if kind == "brand":
        rows = table(spark, d, "part").select(tag("part", "p_partkey").alias("subject"), tag("brand", "p_brand").alias("object"), F.lit(1).cast("bigint").alias("mentions"), F.lit(1.0).alias("confidence"))
        name = "PART_OF_FRANCHISE"
    else:
        a, b, name = {"made": ("l_partkey", "l_suppkey", "PRODUCED_BY"), "acted": ("o_custkey", "l_partkey", "ACTED_IN"), "won": ("l_partkey", "l_orderkey", "WON")}[kind]
        if kind == "acted":
            lines = lines.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        if kind == "won":
            lines = lines.where("l_returnflag = 'R'")
        left, right = {"made": ("part", "supplier"), "acted": ("customer", "part"), "won": ("part", "award")}[kind]
        ends = {"subject": tag(left, a), "object": tag(right, b)}
        lines = lines if by is None else lines.repartition(ends[by])
        rows = lines.groupBy(*([a, b] if by is None else [e.alias(n) for n, e in ends.items()])).agg(F.count("*").alias("mentions"), F.round(1 - F.min("l_discount"), 2).alias("confidence"))
        rows = rows.select(*(e.alias(n) if by is None else n for n, e in ends.items()), "mentions", "confidence")
    return rows.select(F.lit("all").alias("doc_id"), "subject", F.lit(name).alias("predicate"), "object", "confidence", "mentions", F.lit(False).alias("derived"))


def star_entities(spark: SparkSession, d: str) -> DataFrame:
    def part(t: str, key: str, name: str, kind: str, prefix: str, year: str = "null") -> DataFrame:
        return table(spark, d, t).select(F.lit("all").alias("doc_id"), F.concat(F.lit(prefix), F.col(key).cast("string")).alias("key"), F.lit(kind).alias("type"), F.col(name).alias("name"), F.expr(f"cast({year} as int)").alias("year"))

    return part("part", "p_partkey", "p_name", "Film", "part:", "p_size").unionByName(part("supplier", "s_suppkey", "s_name", "Studio", "supplier:")).unionByName(part("customer", "c_custkey", "c_name", "Person", "customer:"))


@query(f"""with {EDGES} select s_name as studio, count(distinct subject) as films, array_to_string(list_sort(list(distinct p_name))[1:8], ' · ') as titles from made join part on subject = 'part:' || p_partkey join supplier on object = 'supplier:' || s_suppkey
where confidence >= 0.95 and p_size = 7 group by s_name""")
def works_by_studio(spark: SparkSession, d: str) -> DataFrame:
    return graph.works_by_studio(star_edges(spark, d, "made"), star_entities(spark, d), 7, 0.95)


@query(f"with {EDGES} select a.subject as first_key, b.object as second_key, count(distinct a.object) as works from acted a join made b on a.object = b.subject where a.confidence >= 0.98 and b.confidence >= 0.98 group by all")
def shared_credits(spark: SparkSession, d: str) -> DataFrame:
    return graph.shared_credits(star_edges(spark, d, "acted", "object").unionByName(star_edges(spark, d, "made", "subject")), "ACTED_IN", "PRODUCED_BY", 0.98)


@query(f"""with {EDGES} select key, count(*) as groups, array_to_string(list_sort(list(grp)), ' · ') as names from (select distinct a.subject as key, b.object as grp from acted a join brand b on a.object = b.subject where a.confidence >= 0.95) group by key having count(*) > 1""")
def members_of_several(spark: SparkSession, d: str) -> DataFrame:
    return graph.members_of_several(star_edges(spark, d, "acted").unionByName(star_edges(spark, d, "brand")), "ACTED_IN", "PART_OF_FRANCHISE", 0.95)


# The three above with every edge (0.6, the operators' own confidence) and every year


@query(f"""with {EDGES} select s_name as studio, count(distinct subject) as films, array_to_string(list_sort(list(distinct p_name))[1:8], ' · ') as titles from made join part on subject = 'part:' || p_partkey join supplier on object = 'supplier:' || s_suppkey
where confidence >= 0.6 group by s_name""")
def all_works_by_studio(spark: SparkSession, d: str) -> DataFrame:
    return graph.works_by_studio(star_edges(spark, d, "made"), star_entities(spark, d))


@query(f"with {EDGES} select a.subject as first_key, b.object as second_key, count(distinct a.object) as works from acted a join made b on a.object = b.subject where a.confidence >= 0.6 and b.confidence >= 0.6 group by all")
def all_shared_credits(spark: SparkSession, d: str) -> DataFrame:
    return graph.shared_credits(star_edges(spark, d, "acted", "object").unionByName(star_edges(spark, d, "made", "subject")), "ACTED_IN", "PRODUCED_BY")


@query(f"""with {EDGES} select key, count(*) as groups, array_to_string(list_sort(list(grp)), ' · ') as names from (select distinct a.subject as key, b.object as grp from acted a join brand b on a.object = b.subject where a.confidence >= 0.6) group by key having count(*) > 1""")
def all_members_of_several(spark: SparkSession, d: str) -> DataFrame:
    return graph.members_of_several(star_edges(spark, d, "acted").unionByName(star_edges(spark, d, "brand")), "ACTED_IN", "PART_OF_FRANCHISE")


@query(f"""with {EDGES}, f as (select subject, min(object) as key from made where confidence >= 0.9 group by subject) select key, count(*) as awards from won join f using (subject) where confidence >= 0.9 group by key""")
def award_tally(spark: SparkSession, d: str) -> DataFrame:
    return graph.tally_by_first(star_edges(spark, d, "made").unionByName(star_edges(spark, d, "won")), "WON", "PRODUCED_BY", 0.9)


@query(f"""with {EDGES} select a.doc_id, a.object as a, b.object as b, count(distinct a.subject) as shared, array_to_string(list_sort(list(distinct p_name))[1:5], ' · ') as titles from made a join made b on a.subject = b.subject and a.object < b.object join part on a.subject = 'part:' || p_partkey group by all""".replace("group by all", "group by a.doc_id, a.object, b.object"))
def collaborations(spark: SparkSession, d: str) -> DataFrame:
    return graph.collaborations(star_edges(spark, d, "made"), star_entities(spark, d), 1, [], ["PRODUCED_BY"], "Studio")


@query(f"""with {EDGES} select subject, predicate, object, confidence, mentions, (select count(*) from made where confidence >= 0.95) as total, (select count(*) from made where confidence >= 0.95) > 400 as truncated from made where confidence >= 0.95 order by subject, predicate, object limit 400""")
def graph_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return graph.snapshot(star_edges(spark, d, "made"), 400, 0.95).select("subject", "predicate", "object", "confidence", "mentions", "total", "truncated")


ROADS = """e as (select 'world' as a, 'region:' || r_regionkey as b from region union select 'region:' || n_regionkey, 'nation:' || n_nationkey from nation union select 'nation:' || s_nationkey, 'supplier:' || s_suppkey from supplier union select 'nation:' || c_nationkey, 'customer:' || c_custkey from customer),
u as (select a, b from e union select b, a from e)"""


def roads(spark: SparkSession, d: str) -> DataFrame:
    tag = lambda prefix, c: F.concat(F.lit(prefix + ":"), F.col(c).cast("string"))
    one = table(spark, d, "nation").select(tag("region", "n_regionkey").alias("a"), tag("nation", "n_nationkey").alias("b"))
    two = table(spark, d, "supplier").select(tag("nation", "s_nationkey").alias("a"), tag("supplier", "s_suppkey").alias("b"))
    top = table(spark, d, "region").select(F.lit("world").alias("a"), tag("region", "r_regionkey").alias("b"))
    return top.unionByName(one).unionByName(two).unionByName(table(spark, d, "customer").select(tag("nation", "c_nationkey").alias("a"), tag("customer", "c_custkey").alias("b")))


@query(f"""with recursive {ROADS}, walk as (select 'supplier:1' as key, 0 as hops union select u.b, hops + 1 from walk join u on walk.key = u.a where hops < 5), best as (select key, min(hops) as hops from walk group by key)
select 'supplier:1' as source, key, hops, case when hops > 0 then (select min(u.a) from u join best p on p.key = u.a where u.b = best.key and p.hops = best.hops - 1) end as parent from best""")
def hops_from_supplier(spark: SparkSession, d: str) -> DataFrame:
    return graph.reach(roads(spark, d), spark.createDataFrame([("supplier:1",)], "key string"), 5)


@query(f"""with recursive {ROADS}, walk as (select 'supplier:1' as key, 0 as hops, ['supplier:1'] as path union all select u.b, hops + 1, list_append(path, u.b) from walk join u on walk.key = u.a where hops < 6 and not list_contains(path, u.b) and (u.b not like 'customer:%' or u.b = 'customer:7') and u.b not like 'supplier:%'),
best as (select path from walk where key = 'customer:7' order by hops, list_reverse(path) limit 1) select (i - 1)::int as hop, path[i] as key from best, range(1, 10) r(i) where i <= len(path)""")
def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    return graph.shortest_path(roads(spark, d), "supplier:1", "customer:7")


MENTIONS = "m as (select distinct doc_id, id as chunk_id, unnest(entity_keys) as k from chunks where strategy = 'fixed')"


@query(f"""with c as (select distinct doc_id, id, strategy_ordinal from chunks where strategy = 'fixed'), ch as (select doc_id, id as chunk_id, lag(id) over w as previous_id, lead(id) over w as next_id from c window w as (partition by doc_id order by strategy_ordinal, id)), {MENTIONS},
e as (select distinct doc_id, left_key as s, right_key as o, coalesce(upper(trim(decision)), 'NONE') as p from merge_decisions where lower(trim(decision)) = 'merge'), u as (select doc_id, s as here, o as there, p from e union all select doc_id, o, s, p from e),
t as (select m.doc_id, m.chunk_id, here, there, p from m join u on m.doc_id = u.doc_id and m.k = u.here), cnt as (select doc_id, chunk_id, count(distinct (least(here, there), greatest(here, there), p)) as edges from t group by all),
far as (select x.doc_id, x.chunk_id, m.chunk_id as other, count(*) as n from (select distinct doc_id, chunk_id, there from t) x join m on m.doc_id = x.doc_id and m.k = x.there where m.chunk_id <> x.chunk_id group by all),
rel as (select doc_id, chunk_id, string_agg(other, ' ' order by r) as related_ids from (select *, row_number() over (partition by doc_id, chunk_id order by n desc, other) as r from far) where r <= 6 group by all),
ent as (select doc_id, chunk_id, string_agg(k, ' ' order by k) as entities from m group by all)
select ch.chunk_id, previous_id, next_id, entities, coalesce(edges, 0) as edges, related_ids from ch left join ent using (doc_id, chunk_id) left join cnt using (doc_id, chunk_id) left join rel using (doc_id, chunk_id)""")
def graph_expansion(spark: SparkSession, d: str) -> DataFrame:
    own = chunks(spark, d, "doc_id", "strategy", "strategy_ordinal", "entity_keys").where("strategy = 'fixed'")
    mentions = own.select("doc_id", F.col("id").alias("chunk_id"), F.explode("entity_keys").alias("entity_key")).distinct()
    said = table(spark, d, "merge_decisions").where("lower(trim(decision)) = 'merge'").select("doc_id", F.col("left_key").alias("subject"), F.upper(F.trim("decision")).alias("predicate"), F.col("right_key").alias("object")).distinct()
    edges = said.withColumn("confidence", F.lit(1.0)).withColumn("derived", F.lit(False))
    return graph.expand(own.select(F.col("id").alias("chunk_id")), own.select("doc_id", "id", "strategy", "strategy_ordinal"), mentions, edges)


# Proposals: order lines as triples (supplier, flag, part)

PROPOSALS = "p as (select 'order:' || l_orderkey as chunk_id, 'supplier:' || l_suppkey as subject, l_returnflag as predicate, 'part:' || l_partkey as object, 'line ' || l_linenumber as evidence, round(1 - l_discount, 2) as confidence, l_linestatus = 'F' as flipped from lineitem)"


def proposals(spark: SparkSession, d: str) -> DataFrame:
    tag = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    return table(spark, d, "lineitem").select(tag("order:", "l_orderkey").alias("chunk_id"), tag("supplier:", "l_suppkey").alias("subject"), F.col("l_returnflag").alias("predicate"), tag("part:", "l_partkey").alias("object"), tag("line ", "l_linenumber").alias("evidence"), F.round(1 - F.col("l_discount"), 2).alias("confidence"), (F.col("l_linestatus") == "F").alias("flipped"))


@query(f"""with {PROPOSALS} select subject, predicate, object, count(*) as mentions, max(confidence) as confidence, bool_or(flipped) as flipped, array_to_string(list_sort(list(distinct chunk_id)), ' ') as chunk_ids, first(evidence order by -length(evidence), chunk_id, evidence) as evidence from p group by all""".replace("group by all", "group by subject, predicate, object"))
def merged_triples(spark: SparkSession, d: str) -> DataFrame:
    merged = extraction.merged_triples(proposals(spark, d))
    return merged.select("subject", "predicate", "object", "mentions", "confidence", "flipped", F.array_join("chunk_ids", " ").alias("chunk_ids"), "evidence")


@query(f"""with {PROPOSALS}, r as (select distinct subject, predicate, object from p where confidence < 0.92) select subject, predicate, object, count(*) as mentions, max(confidence) as confidence, max(confidence) < 0.95 as below_floor from p anti join r using (subject, predicate, object) group by subject, predicate, object""")
def reviewed_triples(spark: SparkSession, d: str) -> DataFrame:
    raw = proposals(spark, d)
    merged = extraction.merged_triples(extraction.without_rejected(raw, raw.where("confidence < 0.92")))
    return extraction.below_floor(merged, 0.95).select("subject", "predicate", "object", "mentions", "confidence", "below_floor")


@query(f"""with {PROPOSALS}, k as (select 'supplier:' || s_suppkey as key from supplier where s_acctbal >= 0 union select 'part:' || p_partkey from part where p_size > 10) select predicate, count(*) as n from p where subject in (select key from k) and object in (select key from k) group by predicate""")
def dangling_removed(spark: SparkSession, d: str) -> DataFrame:
    tag = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string")).alias("key")
    keys = table(spark, d, "supplier").where("s_acctbal >= 0").select(tag("supplier:", "s_suppkey")).unionByName(table(spark, d, "part").where("p_size > 10").select(tag("part:", "p_partkey")))
    return extraction.without_dangling(proposals(spark, d), keys).groupBy("predicate").agg(F.count("*").alias("n"))


@query(f"""with {PROPOSALS}, m as (select 'supplier:' || s_suppkey as old_key, 'nation:' || s_nationkey as new_key from supplier) select coalesce(new_key, subject) as subject, count(*) as n from p left join m on subject = old_key where coalesce(new_key, subject) <> object group by 1""")
def remapped_triples(spark: SparkSession, d: str) -> DataFrame:
    to = lambda prefix, c, a: F.concat(F.lit(prefix), F.col(c).cast("string")).alias(a)
    mapping = table(spark, d, "supplier").select(to("supplier:", "s_suppkey", "old_key"), to("nation:", "s_nationkey", "new_key"))
    return extraction.remapped(proposals(spark, d), mapping).groupBy("subject").agg(F.count("*").alias("n"))


@query(f"""with {PROPOSALS}, t as (select subject, predicate, object, min(chunk_id) as first from p group by subject, predicate, object), n as (select *, row_number() over (partition by first order by subject, predicate, object) - 1 as place from t)
select subject, predicate, object, (place // 2)::int as batch, (place % 2)::int as index from n""")
def verification_batches(spark: SparkSession, d: str) -> DataFrame:
    batched = extraction.verification_batches(extraction.merged_triples(proposals(spark, d)), 2)
    return batched.select("subject", "predicate", "object", "batch", F.col("index").cast("int").alias("index"))


@query(f"""with {EDGES}, e as (select subject as key, predicate, object as other from made union all select object, predicate, subject from made), y as (select 'part:' || p_partkey as other, p_size from part)
select key, array_to_string(list_sort(list(distinct role)), ' ') as roles from (select key, predicate as role from e union all select key, 'y:' || p_size from e join y using (other)) group by key""")
def role_clusters(spark: SparkSession, d: str) -> DataFrame:
    return extraction.role_clusters(star_edges(spark, d, "made"), star_entities(spark, d)).select("key", F.array_join("roles", " ").alias("roles"))


@query(f"""with {PROPOSALS}, t as (select distinct subject, predicate, object, chunk_id from p) select predicate, o_orderpriority as text, count(*) as n from t join orders on chunk_id = 'order:' || o_orderkey group by predicate, o_orderpriority""")
def edge_evidence(spark: SparkSession, d: str) -> DataFrame:
    edges = extraction.merged_triples(proposals(spark, d)).withColumn("doc_id", F.lit("all"))
    texts = table(spark, d, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("text"))
    return graph.edge_evidence(edges, texts).groupBy("predicate", "text").agg(F.count("*").alias("n"))


@query()
def graded_relations(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring entity keys of a chunk proposed as related, the chunk's own sentence as evidence; counts by status."""
    held = chunks(spark, d, "doc_id", "text", "strategy", "entity_keys").where("strategy = 'recursive'")
    pair = held.select("id", "doc_id", "text", F.posexplode(F.arrays_zip(F.slice("entity_keys", 1, F.greatest(F.size("entity_keys") - 1, F.lit(0))).alias("a"), F.slice("entity_keys", 2, F.greatest(F.size("entity_keys"), F.lit(1))).alias("b"))).alias("i", "z"))
    names = table(spark, d, "graph_entities").select("doc_id", "key", "type", "name").dropDuplicates(["doc_id", "key"])
    side = lambda p, c: names.select("doc_id", F.col("key").alias(c), F.col("type").alias(f"{p}_type"), F.col("name").alias(p))
    both = pair.select("id", "doc_id", "i", F.col("z.a").alias("ka"), F.col("z.b").alias("kb")).join(side("subject", "ka"), ["doc_id", "ka"]).join(side("object", "kb"), ["doc_id", "kb"])
    made = both.select(F.col("id").alias("chunk_id"), "subject", "subject_type", F.when(F.col("subject_type") == "Person", "->directed").otherwise("shot by").alias("predicate"), "object", "object_type", F.concat_ws(" and ", "subject", "object").alias("evidence"), (1.0 / (F.col("i") + 1)).alias("confidence"))
    rules = spark.createDataFrame([("DIRECTED", "Person", "Film"), ("SHOT_BY", "Film", "Person"), ("SHOT_BY", "Location", "Location")], "predicate string, from_type string, to_type string")
    return extraction.funnel(extraction.graded_relations(made, held, rules))


# Answers


@query("""select stage, count(*) as n, round(avg((not refused)::double), 6) as pass_rate from (select distinct answer_id, stage, refused from generated_answers) group by stage""")
def pass_rates(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "generated_answers").select("answer_id", "stage", (~F.col("refused")).alias("pass")).distinct()
    return evaluation.pass_rates(cells, ["stage"], digits=6)


@query("""with c as (select distinct answer_id, doc_id, refused from generated_answers), b as (select *, lag(refused) over (partition by doc_id order by answer_id) as before from c) select answer_id, doc_id from b where refused and not before""")
def regressions(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "generated_answers").select("answer_id", "doc_id", (~F.col("refused")).alias("pass")).distinct()
    return evaluation.regressions(cells, "doc_id", "answer_id").select("answer_id", "doc_id")


@query("""select stage, """ + ", ".join(f"round_even(avg(case when chat_calls = {k} then (not refused)::int end), 3) as calls_{k}" for k in range(4)) + """ from (select distinct answer_id, stage, chat_calls, refused from generated_answers) group by stage""")
def heatmap(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "generated_answers").select("answer_id", "stage", "chat_calls", (~F.col("refused")).alias("pass")).distinct()
    wide = evaluation.heatmap(cells, "stage", "chat_calls", [0, 1, 2, 3])
    return wide.select("stage", *[F.col(str(k)).alias(f"calls_{k}") for k in range(4)])


@query(r"""select answer_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(answer, '\[(\d{1,6})\]', 1), lambda x: x::int))), ' ') as marks from (select distinct answer_id, answer from generated_answers) where answer is not null""")
def cited_marks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "generated_answers").where("answer is not null").select("answer_id", "answer").distinct()
    marks = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("answer", F.lit(r"\[(\d{1,6})\]"), F.lit(1)), lambda x: x.cast("int"))))
    return rows.select("answer_id", F.array_join(marks, " ").alias("marks"))


def contexts(spark: SparkSession, d: str) -> DataFrame:
    """(answer_id, rank, chunk_id, text) of the passages quoted in each prompt."""
    rows = table(spark, d, "generated_answers").select("answer_id", F.regexp_replace("prompt", "\r\n?", "\n").alias("p")).distinct()
    parts = rows.select("answer_id", F.explode(F.split("p", r"(?m)(?=^\[\d{1,6}\] \(chunk )")).alias("part")).where(r"part rlike '^\\[[0-9]+\\] \\(chunk '")
    body = F.split("part", r"\n\nQUESTION\n")[0]
    return parts.select("answer_id", F.regexp_extract("part", r"^\[(\d+)\]", 1).cast("int").alias("rank"), F.regexp_extract("part", r"^\[\d+\] \(chunk ([^,]+),", 1).alias("chunk_id"), F.regexp_replace(body, r"^[^\n]*\n", "").alias("text"))


@query()
def answer_groundedness(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "generated_answers").where("answer is not null").select("answer_id", "answer").distinct()
    return evaluation.groundedness(rows, contexts(spark, d))


@query("select user_id, max(ts) as last_used from events group by user_id order by last_used desc, user_id limit 50")
def most_recent(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_used"))
    return files.most_recent(last, "last_used", "user_id")


@query("select event_type, count(*) as n, sum((props->>'$.k')::int)::bigint as total, round(avg(value), 4) as mean_value from events group by event_type")
def json_properties(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("k", F.from_json("props", "k int")["k"])
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.round(F.avg("value"), 4).alias("mean_value"))


@query("select distinct sha256(concat_ws('|', 'mini-lantern-64', text)) as hash from chunks where sha256(concat_ws('|', 'mini-lantern-64', text)) not in (select hash from embedding_cache)")
def missing_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return files.missing_from_cache(table(spark, d, "chunks"), table(spark, d, "embedding_cache"), "mini-lantern-64").select("hash")


def replayed(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """In place of what models would answer: a class for each question in turn, and for every second two searches, its whole and its second half."""
    turn = F.floor(F.col("question_id") / 100).cast("int")
    kinds = asked.select("question_id", F.element_at(F.array(*map(F.lit, ask.ROUTES)), turn % len(ask.ROUTES) + 1).alias("kind"))
    words = F.split("question", " ")
    half = F.array_join(F.slice(words, F.floor(F.size(words) / 2).cast("int") + 1, F.size(words)), " ")
    searches = asked.where(turn % 2 == 0).select("question_id", F.posexplode(F.array("question", half)).alias("i", "question"))
    return kinds, searches.select("question_id", (F.col("i") + 1).alias("iteration"), "question")


@query()
def compared_stages(spark: SparkSession, d: str, every: int = 100) -> DataFrame:
    asked = questions(spark, d, every).join(table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector")), "vec_id")
    vectors = table(spark, d, "vectors").where("vector is not null").select(F.col("chunk_id").alias("id"), "vector").dropDuplicates(["id"])
    held = chunks(spark, d, "doc_id", "strategy", "strategy_ordinal", "start_char", "end_char", "text", "year", "doctype", "subject", "studio", "entity_keys")
    said = table(spark, d, "merge_decisions").where("lower(trim(decision)) = 'merge'").select("doc_id", F.col("left_key").alias("subject"), F.upper(F.trim("decision")).alias("predicate"), F.col("right_key").alias("object")).distinct()
    told, planned = replayed(questions(spark, d, every))
    inputs = ask.Inputs(
        sections=table(spark, d, "sections"), glossary=spark.createDataFrame(ask.GLOSSARY, "phrase string, expansion string"),
        mentions=held.where(F.col("strategy") == ask.GRAPH_STRATEGY).select("doc_id", F.col("id").alias("chunk_id"), F.explode("entity_keys").alias("entity_key")),
        edges=said.withColumn("confidence", F.lit(1.0)).withColumn("derived", F.lit(False)),
        searches=planned, kinds=told,
    )
    return ask.compare(asked, held.drop("entity_keys"), vectors, list(range(1, 12)), inputs)
