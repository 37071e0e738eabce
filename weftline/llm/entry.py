"""The queries of this package and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import bpe, components, knn, mixing, names, neardup, pairs, repetition, segment, terms
from weftline.operators import search
from weftline.plans.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return segment.audited(table(spark, d, "sections"), table(spark, d, "chunks")).where("faulty").select("section_id").distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    long = table(spark, d, "sections").where(F.length("text") > segment.LIMIT)
    return segment.split_texts(long).withColumnRenamed("id", "section_id")


def p1_proper(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of p1_pieces held against the definition of a proper cut: faulty is false but for sections that unbroken runs leave no such cut."""
    long = table(spark, d, "sections").where(F.length("text") > segment.LIMIT).select("id", "text").distinct()
    pieces = segment.split_texts(long).select(F.lit("recursive").alias("strategy"), F.col("id").alias("section_id"), "start_char", "end_char")
    ends = pieces.groupBy("section_id").agg(F.min("start_char").alias("first"), F.max("end_char").alias("chars"), (F.max(F.col("end_char") - F.col("start_char")) <= segment.LIMIT).alias("within"))
    checked = segment.audited(long.withColumn("start_char", F.lit(0)), pieces).select("section_id", "faulty")
    return checked.join(ends, "section_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return names.variant_pairs(table(spark, d, "graph_entities"), table(spark, d, "name_diminutives"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return names.link_variants(table(spark, d, "graph_entities"), table(spark, d, "name_diminutives"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.distinctive(table(spark, d, "chunks"))


def p3_scores(spark: SparkSession, d: str) -> DataFrame:
    return terms.all_scores(table(spark, d, "chunks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = neardup.near_duplicates(neardup.corpus_texts(table(spark, d, "sections"), table(spark, d, "chunks")))
    return found.select("left_id", "right_id").distinct()


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_classes(neardup.corpus_texts(table(spark, d, "sections"), table(spark, d, "chunks")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defective_pairs(table(spark, d, "generated_answers"), table(spark, d, "graph_entities"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    vectors = knn.archive_vectors(table(spark, d, "vectors"), table(spark, d, "embedding_cache"))
    return knn.mutual_pairs(vectors).select("left_id", "right_id").distinct()


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    vectors = knn.archive_vectors(table(spark, d, "vectors"), table(spark, d, "embedding_cache"))
    return knn.nearest(vectors)


def p6_recall(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of the ids that end in 00 held against all rows by brute force: queries of each space, and whether nine tenths of their neighbours are found."""
    vectors = knn.archive_vectors(table(spark, d, "vectors"), table(spark, d, "embedding_cache")).where("vector is not null").dropDuplicates(["space", "id"])
    usable = vectors.where(F.exists("vector", lambda x: x != 0))
    asked = usable.where(F.right("id", F.lit(2)) == "00").withColumnRenamed("id", "question_id")
    near = knn.nearest(vectors).select("space", "id", "other")
    out = None
    for s in sorted(r[0] for r in asked.select("space").distinct().collect()):
        own = asked.where(F.col("space") == s)
        best = search.vector_top(usable.where(F.col("space") == s), own, 6, digits=6).where("id <> question_id")
        first = best.withColumn("r", F.row_number().over(Window.partitionBy("question_id").orderBy("rank"))).where("r <= 5").select(F.col("question_id").alias("id"), F.col("id").alias("other"))
        hit = first.join(near.where(F.col("space") == s).select("id", "other", F.lit(1).alias("hit")), ["id", "other"], "left")
        got = hit.agg(F.lit(s).alias("space"), F.countDistinct("id").alias("queries"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("enough"))
        out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], "space string, queries bigint, enough boolean")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    merged = table(spark, d, "merge_decisions").where(F.lower(F.trim("decision")) == "merge")
    return components.connected_groups(merged, "doc_id", "left_key", "right_key").withColumnRenamed("scope", "doc_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    documents, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    listed = documents.join(F.broadcast(targets.select("source")), "source", "left_semi")
    return mixing.mix(bpe.token_counts(listed, carry=("source",)), targets)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p9_limits(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of every mix, by source: documents drawn more often than allowed, or not of the source, and targets missed though in reach."""
    drawn, shares = _mix(spark, d)
    listed = table(spark, d, "documents").select("doc_id", F.col("source").alias("own"), (F.length("text") > 0).alias("full"))
    checked = drawn.join(listed, "doc_id").join(F.broadcast(shares.select("source", "max_repeats")), "source")
    odd = checked.groupBy("source").agg(F.count_if(F.col("repeats") > F.col("max_repeats")).alias("repeated_too_often"), F.count_if((F.col("own") != F.col("source")) | ~F.col("full")).alias("foreign"))
    per = listed.where("full").groupBy(F.col("own").alias("source")).agg(F.count("*").alias("available"))
    short = (F.col("actual_share") < F.col("target_share") - 0.001) & (F.col("tokens") < F.col("available_tokens") * F.col("max_repeats"))
    out = shares.join(per, "source", "left").join(odd, "source", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return out.select("source", "target_share", "max_repeats", zero("available"), zero("repeated_too_often"), zero("foreign"), short.alias("short"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetitive(table(spark, d, "documents"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetition_scores(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p1_proper, p2_found, p2_groups, p3_found, p3_scores, p4_found, p4_classes, p5_found, p6_found, p6_neighbours, p6_recall, p7_found, p8_ids, p9_shares, p9_documents, p9_limits, p10_found, p10_scores)}


P1 = "select distinct id as section_id, false as faulty, 0 as first, length(text) as chars, true as within from sections where length(text) > 1600"

P3 = """with c as (select distinct id, doc_id, text, entity_keys from chunks where strategy = 'fixed'), w as (select id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as term from c),
t as (select id, term, count(*) as n from w group by id, term), df as (select term, count(*) as df from t group by term), k as (select distinct id, doc_id, unnest(entity_keys) as term from c),
few as (select term from k group by term having count(distinct id) between 2 and 3 and count(distinct doc_id) >= 2)
select id as chunk_id, term from t join df using (term) where n >= 3 and df <= 3 and length(term) >= 4 union select id, term from k join few using (term)"""

P3_SCORES = """with c as (select distinct id, text, entity_keys from chunks), w as (select id, 'word' as kind, unnest(regexp_extract_all(lower(text), '[a-z]+')) as term from c union all select distinct id, 'key', unnest(entity_keys) from c),
t as (select id, kind, term, count(*) as n from w group by id, kind, term), r as (select id, kind, sum(n) as r from t group by id, kind), m as (select kind, term, sum(n) as m from t group by kind, term), g as (select kind, sum(n) as g from t group by kind)
select id as chunk_id, kind, term, case when r < g and m < g then round((n - r::double * m / g) / sqrt(r::double * m / g * (1 - r::double / g) * (1 - m::double / g)), 4) end as score from t join r using (id, kind) join m using (kind, term) join g using (kind)"""

P4 = """with t as (select distinct 'section' as kind, id, text from sections union select distinct 'chunk', id, text from chunks where strategy = 'fixed'),
w as (select kind, id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as word from t), n as (select kind, id, count(*) as n from w group by kind, id having count(*) >= 60),
b as (select kind, id, word, count(*) as c, any_value(n) as n from w join n using (kind, id) group by kind, id, word),
o as (select x.kind, x.id as left_id, y.id as right_id, sum(least(x.c, y.c)) as common, any_value(x.n) + any_value(y.n) as words from b x join b y on x.kind = y.kind and x.word = y.word and x.id < y.id group by x.kind, x.id, y.id)
select distinct left_id, right_id from o where 10 * common >= 4 * words"""

P4_CLASSES = P4.replace("with t as", "with recursive t as").rsplit("\n", 1)[0] + """,
p as (select distinct kind, left_id, right_id from o where 10 * common >= 4 * words), e as (select kind, left_id as a, right_id as b from p union select kind, right_id, left_id from p),
walk as (select kind, a as id, b as other from e union select walk.kind, id, e.b from walk join e on e.kind = walk.kind and e.a = other), c as (select kind, id, min(least(id, other)) as class_id from walk group by kind, id),
l as (select kind, a as id, count(*) as links from e group by kind, a) select kind, id, coalesce(class_id, id) as class_id, coalesce(links, 0) as links from (select distinct kind, id from t) left join c using (kind, id) left join l using (kind, id)"""

P6_RECALL = """select space, count(*) as queries, true as enough from (select distinct 'vectors' as space, chunk_id as id, vector from vectors union select distinct 'cache:' || model_id, hash, vector from embedding_cache)
where vector is not null and len(list_filter(vector, lambda x: x <> 0)) > 0 and right(id, 2) = '00' group by space"""

P6 = """with v as (select distinct 'v' as space, chunk_id as id, vector::double[] as v from vectors where vector is not null union select distinct model_id, hash, vector::double[] from embedding_cache where vector is not null),
u as (select space, id, v from v where list_sum(list_transform(v, lambda x: x * x)) > 0),
s as (select a.space, a.id, b.id as other, round(list_cosine_similarity(a.v, b.v), 6) as c from u a join u b on a.space = b.space and a.id <> b.id),
r as (select *, row_number() over (partition by space, id order by c desc, other) as r from s), top as (select space, id, other from r where r <= 5 and c >= 0.9)
select distinct a.id as left_id, a.other as right_id from top a join top b on a.space = b.space and a.id = b.other and a.other = b.id where a.id < a.other"""

P7 = """with recursive m as (select distinct doc_id, left_key as a, right_key as b from merge_decisions where lower(trim(decision)) = 'merge' and left_key <> right_key),
e as (select doc_id, a, b from m union select doc_id, b, a from m), walk as (select doc_id, a as item_key, a as other from e union select walk.doc_id, item_key, e.b from walk join e on e.doc_id = walk.doc_id and e.a = other)
select doc_id, item_key, min(other) as group_key from walk group by doc_id, item_key"""

P10 = """with w as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as ws from documents where text is not null),
g as (select doc_id, i, array_to_string(ws[i:i + 4], ' ') as gram from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 20)),
later as (select doc_id, i from (select doc_id, i, row_number() over (partition by doc_id, gram order by i) as r from g) where r > 1),
covered as (select doc_id, count(distinct i + k) as n from later, range(0, 5) x(k) group by doc_id)
select doc_id from covered join w using (doc_id) where n * 10 >= len(ws) * 3"""


P9 = """select source, target_share, max_repeats, coalesce(n, 0) as available, 0::bigint as repeated_too_often, 0::bigint as "foreign", false as short
from (select distinct * from mix_targets) left join (select source, count(*) as n from documents where length(text) > 0 group by source) using (source)"""


BLANK = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+"
P10_SCORES = rf"""with w as (select distinct doc_id, coalesce(lower(text), '') as t, coalesce(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), []) as ws from documents), c as (select doc_id, list_sum(list_transform(ws, lambda x: length(x))) as chars from w),
""" + ",".join(f"""g{n} as (select doc_id, i, array_to_string(ws[i:i + {n - 1}], ' ') as gram from (select doc_id, ws, unnest(range(1, len(ws) - {n - 2})) as i from w where len(ws) >= {n})),
l{n} as (select doc_id, i from (select doc_id, i, row_number() over (partition by doc_id, gram order by i) as r from g{n}) where r > 1), v{n} as (select distinct doc_id, i + k as p from l{n}, range(0, {n}) x(k)),
s{n} as (select doc_id, count(*) as places, sum(length(ws[p])) as chars from v{n} join w using (doc_id) group by doc_id)""" for n in repetition.LENGTHS) + rf""",
x0 as (select doc_id, unnest(string_split(t, chr(10))) as x from w), x1 as (select doc_id, regexp_replace(x, '^{BLANK}|{BLANK}$', '', 'g') as x from x0), x2 as (select doc_id, x, count(*) as n from x1 where x <> '' group by doc_id, x), ls as (select doc_id, sum(length(x) * (n - 1)) / sum(length(x) * n) as share from x2 group by doc_id)
select doc_id, len(ws) as words, coalesce(s5.places, 0) as repeated_words, round(coalesce(s5.chars / c.chars, 0), 6) as char_share_5, round(coalesce(s10.chars / c.chars, 0), 6) as char_share_10, round(coalesce(ls.share, 0), 6) as line_share from w join c using (doc_id) left join s5 using (doc_id) left join s10 using (doc_id) left join ls using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """Queries whose rows plain SQL can give; the others are held against brute force in the tests."""
    return {"p1_proper": P1, "p3_found": P3, "p3_scores": P3_SCORES, "p4_found": P4, "p4_classes": P4_CLASSES, "p6_recall": P6_RECALL, "p6_found": P6, "p7_found": P7, "p9_limits": P9, "p10_found": P10, "p10_scores": P10_SCORES}
