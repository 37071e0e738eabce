"""Queries for the steps around retrieval: pages, payloads, replies, review, commit, grading; each calls its operator and stands beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.functions.vectors import unit
from weftline.operators import chunking, evaluation, extraction, graph, resolve, search
from weftline.plans import ask
from weftline.plans.catalog import CHUNKS, EDGES, ORACLE, PROPOSALS, chunks, level_sql, proposals, query, star_edges, star_entities, tokens_sql
from weftline.plans.runtime import table
from weftline.sources import files

SECTIONS = "(select distinct * from sections)"
ENTITIES = "(select distinct doc_id, key, type, name, year, mentions from graph_entities)"
SLUG = "trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', '-', 'g'), '-')"
SENTENCE = r"(?:[^.!?\n]|\.\p{Nd})*[.!?\n]?"


def sections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sections").distinct()


def entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_entities").select("doc_id", "key", "type", "name", "year", "mentions").distinct()


def sentences_sql(column: str) -> str:
    return rf"list_filter(list_transform(regexp_extract_all({column}, '{SENTENCE}'), lambda x: regexp_replace(x, '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g')), lambda x: x <> '')"


# Pages and chunks


@query(f"select doc_id, ordinal, coalesce(sum(length(text) + 2) over (partition by doc_id order by ordinal rows between unbounded preceding and 1 preceding), 0)::bigint as start_char from {SECTIONS}")
def page_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Sections as the pages of their dossier."""
    return chunking.page_offsets(sections(spark, d), page="ordinal").select("doc_id", "ordinal", F.col("start_char").cast("bigint").alias("start_char"))


@query(rf"select doc_id, length(string_agg(text, '--' order by ordinal)) as chars, sha256(string_agg(text, chr(10) || chr(10) order by ordinal)) as hash from {SECTIONS} group by doc_id")
def joined_pages(spark: SparkSession, d: str) -> DataFrame:
    return chunking.joined_pages(sections(spark, d), page="ordinal").select("doc_id", F.length("raw_text").alias("chars"), F.sha2("raw_text", 256).alias("hash"))


@query(f"select doc_id, list_sort(list(length(text)))[count(*) // 2 + 1] as median_chars from {SECTIONS} group by doc_id having list_sort(list(length(text)))[count(*) // 2 + 1] < 1500")
def thin_documents(spark: SparkSession, d: str) -> DataFrame:
    return chunking.scanned_documents(sections(spark, d), least=1500)


RUNNING = f"""l as (select distinct doc_id, page, trim(regexp_replace(heading, '\\p{{Nd}}', '#', 'g')) as shape from {SECTIONS} where heading is not null), n as (select doc_id, count(distinct page) as all_pages from {SECTIONS} where heading is not null group by doc_id having count(distinct page) >= 3)"""


@query(f"with {RUNNING} select doc_id, shape, count(*) as pages from l join n using (doc_id) where shape <> '' group by doc_id, shape, all_pages having count(*) > 0.1 * all_pages")
def running_lines(spark: SparkSession, d: str) -> DataFrame:
    """Headings as if they stood in the upper margin of their page."""
    lines = sections(spark, d).where("heading is not null").select("doc_id", "page", F.col("heading").alias("text"), F.lit(0.02).alias("relative_y"))
    return chunking.running_lines(lines, share=0.1)


@query(f"""with s as (select id as section_id, concat(coalesce(subject, 'Unknown subject'), ' (', coalesce(year::varchar, 'year unknown'), ', ', coalesce(doctype, 'document'), ') — ', coalesce(summary, concat_ws(' ', heading, 'about ' || subject, '(' || year::varchar || ')', '[' || doctype || ']')), ' ') as prefix from {SECTIONS})
select id, sha256(prefix || text) as hash from {CHUNKS} join s using (section_id) where strategy = 'recursive'""")
def contextual_chunks(spark: SparkSession, d: str) -> DataFrame:
    own = chunks(spark, d, "section_id", "strategy", "text").where("strategy = 'recursive'")
    return chunking.contextual_chunks(own, sections(spark, d)).select("id", F.sha2("text", 256).alias("hash"))


@query(f"""with c as (select c.id, c.doc_id, c.strategy, s.ordinal as so, c.start_char, case c.strategy when 'fixed' then 1 when 'recursive' then 2 else 3 end as r from {CHUNKS} c join {SECTIONS} s on s.id = c.section_id)
select id, row_number() over (partition by doc_id order by r, so, start_char, id) - 1 as seq, row_number() over (partition by doc_id, strategy order by so, start_char, id) - 1 as strategy_ordinal, lead(id) over (partition by doc_id, strategy order by so, start_char, id) as next_id from c""")
def numbered_chunks(spark: SparkSession, d: str) -> DataFrame:
    own = chunks(spark, d, "doc_id", "strategy", "section_id", "start_char").join(sections(spark, d).select(F.col("id").alias("section_id"), F.col("ordinal").alias("section_ordinal")), "section_id")
    return chunking.numbered(own).select("id", "seq", "strategy_ordinal", "next_id")


@query("select doc_id, rtrim(case when instr(text, '. ') > 0 then left(text, instr(text, '. ') - 1) else text end, ' ') as text from documents where text is not null")
def first_sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null")
    cut = files.before_marker(rows.select("doc_id", "text"), ". ")
    return cut.select("doc_id", F.rtrim("text").alias("text"))


# Payloads and lists


@query(f"""select c.id as chunk_id, c.doc_id, s.heading as section, c.doctype, c.subject, c.year, c.studio, c.market, c.page, c.seq, length(c.text) as chars, array_to_string(c.entity_keys, ' ') as keys from {CHUNKS} c join {SECTIONS} s on s.id = c.section_id""")
def chunk_payloads(spark: SparkSession, d: str) -> DataFrame:
    own = chunks(spark, d, "doc_id", "section_id", "doctype", "subject", "year", "studio", "market", "page", "seq", "text", "entity_keys")
    return search.payloads(own, sections(spark, d)).withColumn("chars", F.length("text")).withColumn("keys", F.array_join("entity_keys", " ")).drop("text", "entity_keys")


@query("select id, uploaded_utc from (select distinct id, uploaded_utc from dossiers) order by uploaded_utc desc, id limit 20")
def newest_dossiers(spark: SparkSession, d: str) -> DataFrame:
    return search.newest(table(spark, d, "dossiers").select("id", "uploaded_utc").distinct(), "uploaded_utc", "id", 20)


@query("select question_id, id, greatest(0, least(1, coalesce(model, case when max(lexical) over (partition by question_id) > 0 then lexical / max(lexical) over (partition by question_id) * 0.5 else 0 end))) as score from (select source as question_id, doc_id as id, n_chars::double as lexical, case when doc_id % 3 = 0 then (doc_id % 7) / 5.0 end as model from documents where source is not null)")
def fallback_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("source is not null").select(F.col("source").alias("question_id"), F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("lexical"), F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") % 7) / 5.0).alias("model"))
    return search.with_fallback(rows).select("question_id", "id", "score")


@query("select vec_id, round(embedding[1]::double / sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as first, 64 as width from embeddings")
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", unit(F.col("embedding")).alias("u"))
    return rows.select("vec_id", F.round(F.col("u")[0], 6).alias("first"), F.size("u").alias("width"))


MD5 = "md5(id)"


@query(f"""select id, concat(substr({MD5}, 7, 2), substr({MD5}, 5, 2), substr({MD5}, 3, 2), substr({MD5}, 1, 2), '-', substr({MD5}, 11, 2), substr({MD5}, 9, 2), '-', substr({MD5}, 15, 2), substr({MD5}, 13, 2), '-', substr({MD5}, 17, 4), '-', substr({MD5}, 21, 12)) as point from (select distinct id from chunks)""")
def point_ids(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("id", X.point_id(F.col("id")).alias("point"))


@query(rf"""select id, concat_ws(', ', 'docType=' || doctype, 'year=' || year::varchar, 'subject=' || subject, 'studio=' || studio) as filter, case when contains(lower(text), 'franchise') then 'multi-franchise-actors' when contains(lower(text), 'award') or contains(lower(text), 'won') or contains(lower(text), 'wins') then 'award-tally-by-studio'
when contains(lower(text), 'cinematograph') or contains(lower(text), 'shot') or contains(lower(text), 'photography') then 'director-cinematographer-pairs' else 'studio-film-count' end as preset,
nullif(regexp_extract(text, '(?:^|[^\p{{L}}\p{{Nd}}])(19\d{{2}}|20\d{{2}}|2100)(?:[^\p{{L}}\p{{Nd}}]|$)', 1), '')::int as year from {SECTIONS}""")
def guesses(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("int")
    rows = sections(spark, d)
    return rows.select("id", X.filter_description(F.col("doctype"), F.col("year"), none, none, F.col("subject"), F.col("studio")).alias("filter"), X.preset_guess(F.col("text")).alias("preset"), X.year_guess(F.col("text")).alias("year"))


# Names


@query(f"""select distinct doc_id, key, case when type in ('Film', 'TVSeries') and year is not null then lower(type) || ':' || {SLUG.format('name')} || ':' || year::varchar when type = 'Character' then lower(type) || ':' || {SLUG.format('name')} || ':unscoped' else lower(type) || ':' || {SLUG.format('name')} end as built, split_part(key, ':', 1) as kind from {ENTITIES} where name is not null and type is not null""")
def built_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = entities(spark, d).where("name is not null and type is not null")
    return rows.select("doc_id", "key", X.entity_key(F.col("type"), X.folded(F.col("name")), F.col("year"), F.lit(None).cast("string")).alias("built"), X.key_kind(F.col("key")).alias("kind")).distinct()


STUDIO_NORM = rf"trim(regexp_replace(lower(strip_accents(name)), '(\s+({'|'.join(X.STUDIO_WORDS)})[.,]*)+$', ''))"


def studio_clusters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    none = lambda t: F.lit(None).cast(t)
    rows = entities(spark, d).where("type = 'Studio' and name is not null").dropDuplicates(["doc_id", "key"])
    rows = rows.select(F.col("doc_id").alias("scope"), "type", "key", "name", X.normal_studio(X.folded(F.col("name"))).alias("norm"), "year", none("string").alias("work"), F.lit("").alias("ordinal"), none("array<string>").alias("roles"), "mentions", none("array<double>").alias("vector"))
    return rows, resolve.resolve(rows)


CLUSTERED = f"""e as (select *, {STUDIO_NORM} as norm from {ENTITIES} where type = 'Studio' and name is not null), m as (select doc_id as scope, key, name, mentions, first_value(key) over (partition by doc_id, norm order by mentions desc, key) as cluster from e)"""


@query(f"with {CLUSTERED} select scope, key, cluster, 'member' as how from m")
def resolved_studios(spark: SparkSession, d: str) -> DataFrame:
    """Studios without vectors: equal normal names merge around the most mentioned."""
    return studio_clusters(spark, d)[1]


@query(f"""with {CLUSTERED}, n as (select scope, cluster, name, sum(mentions) as m, count(*) as n from m group by all), b as (select scope, cluster, max(row(m, n, name)) as b, list_sort(list(name)) as names, sum(m)::bigint as mentions from n group by all)
select scope, cluster, struct_extract(b, 3) as name, array_to_string(list_filter(names, lambda x: x <> struct_extract(b, 3)), ' · ') as aliases, mentions from b""".replace("n as (select scope, cluster, name, sum(mentions) as m, count(*) as n from m group by all)", "n as (select scope, cluster, name, sum(mentions) as m, count(*) as n from m group by scope, cluster, name)").replace("from n group by all)", "from n group by scope, cluster)"))
def canonical_studios(spark: SparkSession, d: str) -> DataFrame:
    rows, found = studio_clusters(spark, d)
    return resolve.canonical(rows, found).withColumn("aliases", F.array_join("aliases", " · "))


# Replies, review, commit


@query("select distinct chunk_id, payload as json from vectors")
def json_objects(spark: SparkSession, d: str) -> DataFrame:
    """Payloads wrapped in talk and fences, as models reply."""
    said = table(spark, d, "vectors").select("chunk_id", F.concat(F.lit("Here it is {as asked:\n```json\n"), "payload", F.lit("\n```\nAnything else? {\"a\": 1}")).alias("reply")).distinct()
    return files.json_objects(said, "chunk_id", "reply")


def chunk_replies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Replies that propose the entities of each recursive chunk, with their names as evidence, and neighbouring ones as related."""
    held = chunks(spark, d, "doc_id", "strategy", "text", "subject", "year", "entity_keys").where("strategy = 'recursive'")
    named = held.select("id", "doc_id", F.posexplode("entity_keys").alias("i", "key")).join(entities(spark, d).dropDuplicates(["doc_id", "key"]).select("doc_id", "key", "type", "name"), ["doc_id", "key"])
    one = F.struct(F.col("name"), F.col("type"), F.col("name").alias("evidence"))
    per = named.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", one.alias("e")))).alias("es"))
    e = F.transform("es", lambda x: x["e"])
    related = F.transform(F.slice("es", 2, F.size("es")), lambda x: F.struct(F.upper(x["e"]["name"]).alias("subject"), F.lit("related to").alias("predicate"), F.col("es")[0]["e"]["name"].alias("object")))
    return per.select(F.col("id").alias("chunk_id"), F.to_json(F.struct(e.alias("entities"), related.alias("relations"))).alias("json")), held


REPLIED = f"""h as (select id, doc_id, text, year, unnest(entity_keys) as key, generate_subscripts(entity_keys, 1) as i from {CHUNKS} where strategy = 'recursive'), e as (select h.*, type, name from h join (select doc_id, key, min(type) as type, min(name) as name from {ENTITIES} group by doc_id, key) using (doc_id, key)),
g as (select id as chunk_id, i, type, trim(name) as name, case when coalesce(trim(name), '') = '' then 'blank' when type not in ('Person', 'Film', 'Studio') then 'unknown-type' when length({level_sql('name')}) >= 3 and contains({level_sql('text')}, {level_sql('name')}) then 'kept' else 'ungrounded' end as status from e)"""


@query(f"with {REPLIED} select status, type, count(*) as n, count(distinct chunk_id) as chunks from g group by status, type")
def graded_entities(spark: SparkSession, d: str) -> DataFrame:
    replies, held = chunk_replies(spark, d)
    kinds = spark.createDataFrame([("Person",), ("Film",), ("Studio",)], "type string")
    return extraction.graded_entities(replies, held, kinds).groupBy("status", "type").agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("chunks"))


@query(f"""with {REPLIED}, ok as (select distinct chunk_id, lower(name) as low from g where status = 'kept'), f as (select chunk_id, min_by(name, i) as object from g group by chunk_id), f2 as (select f.*, low is not null as known from f left join ok on f.chunk_id = ok.chunk_id and lower(f.object) = low),
r as (select g.chunk_id, g.i, ok.low is not null and f2.known as endpoints, row_number() over (partition by g.chunk_id order by g.i) as nth from g join f2 using (chunk_id) left join ok on ok.chunk_id = g.chunk_id and ok.low = lower(g.name)) select endpoints, count(*) as n from r where nth > 1 group by endpoints""")
def proposed_relations(spark: SparkSession, d: str) -> DataFrame:
    replies, held = chunk_replies(spark, d)
    kinds = spark.createDataFrame([("Person",), ("Film",), ("Studio",)], "type string")
    read = extraction.proposed_relations(replies, extraction.graded_entities(replies, held, kinds))
    return read.groupBy("endpoints").agg(F.count("*").alias("n"))


@query("""with r as (select user_id, event_type, event_id, unnest([struct_pack(name := 'k', value := props->>'$.k'), struct_pack(name := 'half', value := (event_id // 2)::varchar)]) as p from events)
select user_id, event_type, string_agg(name || '=' || value, ' ' order by name) as properties from (select user_id, event_type, p.name as name, min_by(p.value, event_id) as value from r group by all) group by user_id, event_type""".replace("group by all", "group by user_id, event_type, p.name"))
def merged_properties(spark: SparkSession, d: str) -> DataFrame:
    said = table(spark, d, "events").select(F.col("user_id").alias("subject"), F.col("event_type").alias("predicate"), F.lit("x").alias("object"), F.col("event_id").alias("chunk_id"), F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("half"), F.floor(F.col("event_id") / 2).cast("string")).alias("properties"))
    told = F.array_join(F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
    return extraction.merged_properties(said).select(F.col("subject").alias("user_id"), F.col("predicate").alias("event_type"), told.alias("properties"))


@query(f"""with {PROPOSALS}, t as (select subject, predicate, object, min(chunk_id) as first, max(confidence) as c from p group by subject, predicate, object), b as (select *, row_number() over (partition by first order by subject, predicate, object) - 1 as place from t),
v as (select *, case when place % 3 = 0 then 'UNSUPPORTED' when place % 3 = 1 then 'PARTIAL' end as v from b) select subject, predicate, object, round(case when v = 'PARTIAL' then c * 0.7 else c end, 6) as confidence from v where v is null or v <> 'UNSUPPORTED'""")
def verified_triples(spark: SparkSession, d: str) -> DataFrame:
    """Of every ten triples of a chunk the 1st, 4th, ... are unsupported, the 2nd, 5th, ... partly supported."""
    batched = extraction.verification_batches(extraction.merged_triples(proposals(spark, d)), 10)
    place = F.col("batch") * 10 + F.col("index")
    said = batched.select(F.col("chunk_ids")[0].alias("chunk_id"), "batch", "index", F.when(place % 3 == 0, " unsupported").when(place % 3 == 1, "Partial").alias("verdict")).where("verdict is not null")
    return extraction.with_verdicts(batched, said).select("subject", "predicate", "object", F.round("confidence", 6).alias("confidence"))


@query(f"""with {PROPOSALS}, docs as (select 'doc:' || (right(subject, 1)) as doc_id, * from p), fresh as (select doc_id, subject, predicate, object, max(confidence) as confidence, count(*) as mentions from docs where doc_id <> 'doc:3' group by doc_id, subject, predicate, object),
old as (select doc_id, subject, predicate, object, 0.5 as confidence, 1 as mentions from docs where doc_id in ('doc:3', 'doc:4') group by doc_id, subject, predicate, object) select doc_id, count(*) as edges, sum(mentions)::bigint as mentions, round(sum(confidence), 4) as confidence from (select * from fresh union all select * from old where doc_id = 'doc:3') group by doc_id""")
def committed_edges(spark: SparkSession, d: str) -> DataFrame:
    """Triples committed twice over a store of two documents, one of which is replaced."""
    rows = proposals(spark, d).withColumn("doc_id", F.concat(F.lit("doc:"), F.right("subject", F.lit(1)))).withColumn("mentions", F.lit(1).cast("bigint")).withColumn("chunk_ids", F.array("chunk_id"))
    old = rows.where("doc_id in ('doc:3', 'doc:4')").dropDuplicates(["doc_id", "subject", "predicate", "object"]).withColumn("confidence", F.lit(0.5))
    fresh = rows.where("doc_id <> 'doc:3'")
    again = extraction.committed(fresh, extraction.committed(fresh, old))
    return again.groupBy("doc_id").agg(F.count("*").alias("edges"), F.sum("mentions").alias("mentions"), F.round(F.sum("confidence"), 4).alias("confidence"))


GRADED = "g as (select l_orderkey as chunk_id, case l_returnflag when 'R' then 'ungrounded' when 'A' then case when l_linenumber > 5 then 'wrong-types' else 'kept' end else 'kept' end as status, l_linestatus = 'F' and l_returnflag <> 'R' and l_linenumber <= 5 as flipped, case when l_linenumber = 1 then 'RELATED_TO' else 'MADE' end as predicate from lineitem)"


@query(f"""with {GRADED} select count(*) as n, sum((status = 'kept')::int)::bigint as kept, round(avg((status <> 'ungrounded')::int), 6) as grounding_rate, round(avg((status <> 'wrong-types')::int), 6) as conformance_rate, round(sum(flipped::int) / sum((status = 'kept')::int), 6) as flip_rate,
round(sum((status = 'kept' and predicate = 'RELATED_TO')::int) / sum((status = 'kept')::int), 6) as vague_rate, round(sum((status = 'kept')::int) / count(distinct chunk_id), 6) as kept_per_chunk, concat_ws(' ', case when sum((status = 'kept' and predicate = 'RELATED_TO')::int) / sum((status = 'kept')::int) > 0.2 then 'vague' end,
case when sum(flipped::int) / sum((status = 'kept')::int) > 0.15 then 'flipped' end, case when avg((status <> 'ungrounded')::int) < 0.7 then 'ungrounded' end) as warnings from g""")
def extraction_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as graded proposals."""
    status = F.expr("case l_returnflag when 'R' then 'ungrounded' when 'A' then case when l_linenumber > 5 then 'wrong-types' else 'kept' end else 'kept' end")
    flipped = (F.col("l_linestatus") == "F") & (F.col("l_returnflag") != "R") & (F.col("l_linenumber") <= 5)
    return extraction.metrics(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), status.alias("status"), flipped.alias("flipped"), F.when(F.col("l_linenumber") == 1, "RELATED_TO").otherwise("MADE").alias("predicate")))


@query("select count(*) as n, round(avg((lower(trim(decision)) = 'reject')::int), 6) as rejection_rate from (select distinct * from merge_decisions) where decision is not null")
def rejection_rate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "merge_decisions").distinct().where("decision is not null")
    return evaluation.rejection_rate(rows.withColumn("rejected", F.lower(F.trim("decision")) == "reject"), "rejected")


# Graph


@query(f"""with {EDGES}, m as (select * from made where confidence >= 0.95 order by subject, predicate, object limit 100), k as (select subject as key from m union select object from m) select key, name, type from (select 'part:' || p_partkey as key, p_name as name, 'Film' as type from part union all select 'supplier:' || s_suppkey, s_name, 'Studio' from supplier) join k using (key)""")
def snapshot_nodes(spark: SparkSession, d: str) -> DataFrame:
    shown = graph.snapshot(star_edges(spark, d, "made"), 100, 0.95)
    return graph.snapshot_nodes(shown, star_entities(spark, d)).select("key", "name", "type")


@query(f"""with {EDGES}, f as (select subject, min(object) as key from made where confidence >= 0.6 group by subject) select key, count(*) as awards from won join f using (subject) where confidence >= 0.6 group by key""")
def preset_awards(spark: SparkSession, d: str) -> DataFrame:
    return graph.aggregate("award-tally-by-studio", star_edges(spark, d, "made").unionByName(star_edges(spark, d, "won")), star_entities(spark, d))


@query("""with q as (select c_custkey as question_id, lower('How is ' || c_name || ' tied to Customer#' || lpad((c_custkey * 7 % 1000)::varchar, 9, '0') || '?') as q from customer where c_custkey % 10 = 1), p as (select 'customer:' || c_custkey as key, lower(c_name) as name from customer),
m as (select question_id, key, row_number() over (partition by question_id order by length(name) desc, key) as r from q join p on contains(q, name)) select question_id, max(case when r = 1 then key end) as from_key, max(case when r = 2 then key end) as to_key from q left join m using (question_id) group by question_id""")
def path_endpoints(spark: SparkSession, d: str) -> DataFrame:
    who = F.concat(F.lit("How is "), "c_name", F.lit(" tied to Customer#"), F.lpad((F.col("c_custkey") * 7 % 1000).cast("string"), 9, "0"), F.lit("?"))
    asked = table(spark, d, "customer").where("c_custkey % 10 = 1").select(F.col("c_custkey").alias("question_id"), who.alias("question"))
    return graph.endpoints(asked, star_entities(spark, d))


@query(f"""with {EDGES}, a as (select min(object) as s from made), b as (select min(subject) as p from made, a where object = s), c as (select max(object) as t from made, b where subject = p) select 1 as hop, s1.s_name as here, 'PRODUCED_BY' as predicate, false as forward, p_name as there from a, b, supplier s1, part where s = 'supplier:' || s1.s_suppkey and p = 'part:' || p_partkey
union all select 2, p_name, 'PRODUCED_BY', true, s2.s_name from b, c, supplier s2, part where t = 'supplier:' || s2.s_suppkey and p = 'part:' || p_partkey""")
def path_steps(spark: SparkSession, d: str) -> DataFrame:
    """From the first studio over its first work to the last studio of that work."""
    made = star_edges(spark, d, "made")
    first = made.agg(F.min("object")).scalar()
    work = made.where(F.col("object") == first).agg(F.min("subject")).scalar()
    last = made.where(F.col("subject") == work).agg(F.max("object")).scalar()
    path = spark.range(1).select(F.posexplode(F.array(first, work, last)).alias("hop", "key"))
    return graph.path_steps(path, made, star_entities(spark, d)).select("hop", "here", "predicate", "forward", "there")


# Prompts and grading


@query(f"""with c as (select section_id, string_agg('[' || (strategy_ordinal + 1)::varchar || '] ' || text, chr(10) || chr(10) order by strategy_ordinal, id) as context from {CHUNKS} where strategy = 'fixed' group by section_id)
select s.id as question_id, sha256('### system' || chr(10) || 'Answer.' || chr(10) || chr(10) || '### user' || chr(10) || 'CONTEXT' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'QUESTION' || chr(10) || heading) as hash from {SECTIONS} s left join c on c.section_id = s.id""")
def section_prompts(spark: SparkSession, d: str) -> DataFrame:
    asked = sections(spark, d).select(F.col("id").alias("question_id"), F.col("heading").alias("question"))
    own = chunks(spark, d, "section_id", "strategy", "strategy_ordinal", "text").where("strategy = 'fixed'").select(F.col("section_id").alias("question_id"), (F.col("strategy_ordinal") + 1).alias("rank"), "text")
    return ask.prompts(asked, own, "Answer.").select("question_id", F.sha2("prompt", 256).alias("hash"))


@query("""select doc_id, response from (select doc_id, sha256(coalesce(source, '') || '|' || coalesce(text, '')) as k from documents) left join (select sha256(coalesce(source, '') || '|' || coalesce(text, '')) as k, min('reply ' || doc_id::varchar) as response from documents where doc_id % 2 = 0 group by 1) using (k)""")
def replayed_replies(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source", "text")
    kept = rows.where("doc_id % 2 = 0").groupBy(X.content_key(F.col("source"), F.col("text")).alias("key")).agg(F.min(F.concat(F.lit("reply "), F.col("doc_id").cast("string"))).alias("response"))
    return files.replies_to(rows, kept, ["source", "text"]).select("doc_id", "response")


@query("""select doc_id, answer, answer is not null as cached from (select doc_id, left(sha256(coalesce(text, '')), 24) as k from documents) left join (select left(sha256(coalesce(text, '')), 24) as k, min('answer ' || doc_id::varchar) as answer from documents where doc_id % 3 = 0 group by 1) using (k)""")
def cached_answers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "text")
    key = F.left(X.content_key(F.col("text")), F.lit(24))
    good = rows.where("doc_id % 3 = 0").groupBy(key.alias("key")).agg(F.min(F.concat(F.lit("answer "), F.col("doc_id").cast("string"))).alias("answer")).withColumn("warning", F.lit(None).cast("string"))
    failed = rows.where("doc_id % 3 = 1").select(key.alias("key"), F.lit("bad").alias("answer"), F.lit("Call FAILED").alias("warning"))
    return ask.cached_answers(rows, good.unionByName(failed), ["text"]).select("doc_id", "answer", "cached")


TIGHT = "replace({0}, ' ', '')"


@query(f"""with r as (select distinct answer_id, doc_id, stage, answer from generated_answers), t as (select id as doc_id, min(title) as title from dossiers group by id), j as (select r.*, title, answer_id % 5 = 0 as want_refusal, coalesce(trim(lower(rtrim(trim(answer), '.'))) = '{X.REFUSAL_TEXT}', false) as refused from r join t using (doc_id))
select answer_id as question_id, stage, case when want_refusal then case when stage = 0 then not refused and coalesce(answer, '') <> '' else refused end else not refused and answer_id % 7 <> 0 and length({TIGHT.format(level_sql('title'))}) > 0 and contains({TIGHT.format(level_sql("coalesce(answer, '')"))}, {TIGHT.format(level_sql('title'))}) end as pass from j""")
def graded_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers held against the title of their dossier; every fifth should refuse, every seventh has nothing expected."""
    rows = table(spark, d, "generated_answers").select("answer_id", "doc_id", "stage", "answer").distinct()
    title = table(spark, d, "dossiers").groupBy(F.col("id").alias("doc_id")).agg(F.min("title").alias("title"))
    golden = rows.join(title, "doc_id").select(F.col("answer_id").alias("id"), F.lit("simple_lookup").alias("type"), F.when(F.col("answer_id") % 7 != 0, F.array("title")).alias("expected_contains"), F.lit(None).cast("array<string>").alias("expected_path"), (F.col("answer_id") % 5 == 0).alias("expect_refusal"))
    said = rows.select(F.col("answer_id").alias("question_id"), "stage", "answer", F.lit(None).cast("array<string>").alias("path"))
    return evaluation.graded(said, golden).select("question_id", "stage", "pass")


@query(f"""with want as (select section_id, id, seq from {CHUNKS} where strategy = 'fixed') select section_id as question_id, round(avg((seq % 3 = 0)::int), 6) as recall from want group by section_id""")
def retrieval_recall(spark: SparkSession, d: str) -> DataFrame:
    """Every third fixed chunk as retrieved, all of a section's as expected."""
    own = chunks(spark, d, "section_id", "strategy", "seq").where("strategy = 'fixed'")
    want = own.groupBy(F.col("section_id").alias("question_id")).agg(F.collect_list("id").alias("expected_chunk_ids")).withColumn("expected_sections", F.lit(None).cast("array<string>"))
    hits = own.where("seq % 3 = 0").select(F.col("section_id").alias("question_id"), F.col("id").alias("chunk_id"), F.lit("").alias("section"), F.lit("").alias("text"))
    return evaluation.recall(hits, want)


BARE = r"regexp_replace(s, '\[\d+\]', '', 'g')"
SAID = rf"""a as (select distinct answer_id, answer from generated_answers where answer is not null), s0 as (select answer_id, unnest(ss) as s, generate_subscripts(ss, 1) as n from (select answer_id, {sentences_sql('answer')} as ss from a)),
s as (select answer_id, n, list_distinct(list_transform(regexp_extract_all(s, '\[(\d{{1,6}})\]', 1), lambda x: x::int)) as marks, list_distinct({tokens_sql(BARE)}) as terms, length(trim({BARE})) >= 15 and len({tokens_sql(BARE)}) >= 3 as factual from s0)"""
HELD = rf"""c0 as (select answer_id, unnest(string_split(regexp_replace(p, '(?m)^(\[\d{{1,6}}\] \(chunk )', chr(1) || '\1', 'g'), chr(1))) as part from (select distinct answer_id, replace(replace(prompt, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as p from generated_answers)),
c as (select answer_id, regexp_extract(part, '^\[(\d+)\]', 1)::int as mark, {sentences_sql("regexp_replace(string_split(part, chr(10) || chr(10) || 'QUESTION' || chr(10))[1], '^[^' || chr(10) || ']*' || chr(10), '')")} as parts from c0 where regexp_matches(part, '^\[[0-9]+\] \(chunk '))"""


@query(f"with {SAID} select answer_id, count(*) as sentences, sum(factual::int)::bigint as factual, sum(len(marks))::bigint as marks from s group by answer_id")
def cited_sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "generated_answers").where("answer is not null").select("answer_id", "answer").distinct()
    said = evaluation.cited_sentences(rows)
    return said.groupBy("answer_id").agg(F.count("*").alias("sentences"), F.sum(F.col("factual").cast("int")).alias("factual"), F.sum(F.size("marks")).alias("marks"))


ORACLE["answer_groundedness"] = rf"""with {SAID}, {HELD}, m as (select answer_id, n, unnest(marks) as mark, terms from s where factual), o as (select m.answer_id, m.n, list_max(list_transform(parts, lambda x: case when len(terms) > 0 then len(list_filter(terms, lambda t: list_contains({tokens_sql('x')}, t))) / len(terms) else 0 end)) as o from m join c using (answer_id, mark)),
good as (select answer_id, count(distinct n) as supported from o where o >= 0.4 group by answer_id), f as (select answer_id, sum(factual::int) as factual from s group by answer_id), has as (select distinct answer_id from c)
select a.answer_id, coalesce(factual, 0)::bigint as factual, coalesce(supported, 0) as supported, case when has.answer_id is null or not regexp_matches(answer, '\S') then 0 when coalesce(factual, 0) = 0 then 1 else round(coalesce(supported, 0) / factual, 3) end as groundedness from a left join f using (answer_id) left join good using (answer_id) left join has on has.answer_id = a.answer_id"""
