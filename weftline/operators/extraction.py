"""Proposed triples on their way to a graph: conformance, grounding, direction, duplicates, verdicts, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import entity_key, folded, is_grounded, predicate_name, repaired_evidence, work_slug

#: What a model replies for a chunk, once its JSON is cut out.
REPLY = (
    "entities array<struct<name:string,type:string,year:int,evidence:string>>,"
    "relations array<struct<subject:string,predicate:string,object:string,evidence:string,confidence:double,properties:map<string,string>>>"
)


def graded_entities(replies: DataFrame, chunks: DataFrame, types: DataFrame) -> DataFrame:
    """(chunk_id, place, name, type, year, work, key, evidence, status) of the entities that replies (chunk_id, json) propose.

    ``chunks`` has (id, text, subject, year[, section_subject]), ``types`` (type) the known types. Status is
    the first that applies: blank, unknown-type, ungrounded, repaired, kept. Evidence that is not in the
    chunk is replaced by the shortest sentence that holds the name, if there is one. A film without a
    year takes the chunk's; a character belongs to the first film or series of the reply, else to the
    chunk's or section's subject. Replies for unknown chunks and replies that are no JSON are left out.
    """
    held = chunks.select(F.col("id").alias("chunk_id"), F.col("text").alias("__text"), F.col("subject").alias("__subject"), F.col("year").alias("__year"), (F.col("section_subject") if "section_subject" in chunks.columns else F.lit(None).cast("string")).alias("__section"))
    read = replies.select("chunk_id", F.from_json("json", REPLY).alias("r")).where("r is not null").join(held, "chunk_id")
    works = F.filter("r.entities", lambda e: e["type"].isin("Film", "TVSeries"))
    all_ = read.select("chunk_id", "__text", "__year", "__subject", "__section", F.try_element_at(works, F.lit(1))["name"].alias("__first"), F.posexplode("r.entities").alias("place", "e"))
    e = all_.join(F.broadcast(types.select(F.col("type").alias("__type"), F.lit(True).alias("__known")).distinct()), F.col("e.type") == F.col("__type"), "left")
    name = F.trim("e.name")
    grounded = is_grounded(F.col("e.evidence"), F.col("__text"))
    repaired = repaired_evidence(F.col("__text"), F.array(name))
    status = F.when(F.coalesce(name, F.lit("")) == "", "blank").when(F.col("__known").isNull(), "unknown-type").when(grounded, "kept").when(repaired.isNotNull(), "repaired").otherwise("ungrounded")
    year = F.coalesce("e.year", F.when(F.col("e.type") == "Film", F.col("__year")))
    work = F.when(F.col("e.type") == "Character", work_slug(folded(F.col("__first")), folded(F.col("__subject")), folded(F.col("__section"))))
    return e.select("chunk_id", "place", name.alias("name"), F.col("e.type").alias("type"), year.alias("year"), work.alias("work"), entity_key(F.col("e.type"), folded(name), year, work).alias("key"), F.when(grounded, F.col("e.evidence")).otherwise(repaired).alias("evidence"), status.alias("status"))


def proposed_relations(replies: DataFrame, entities: DataFrame) -> DataFrame:
    """(chunk_id, subject, subject_type, subject_key, predicate, object, object_type, object_key, evidence, confidence, properties, endpoints).

    The relations of replies (chunk_id, json), their ends looked up by name, whatever the case, among the kept or repaired
    ``entities`` of the same reply; of equal names the last counts. ``endpoints`` is false where an end is missing.
    """
    ok = entities.where(F.col("status").isin("kept", "repaired")).groupBy("chunk_id", F.lower("name").alias("__low")).agg(F.max_by(F.struct("name", "type", "key"), "place").alias("e"))
    side = lambda p: ok.select("chunk_id", F.col("__low").alias(f"__{p}"), F.col("e.name").alias(f"{p}_name"), F.col("e.type").alias(f"{p}_type"), F.col("e.key").alias(f"{p}_key"))
    rows = replies.select("chunk_id", F.explode(F.from_json("json", REPLY)["relations"]).alias("r")).where("trim(r.subject) <> '' and trim(r.object) <> ''")
    rows = rows.withColumn("__subject", F.lower(F.trim("r.subject"))).withColumn("__object", F.lower(F.trim("r.object")))
    both = rows.join(side("subject"), ["chunk_id", "__subject"], "left").join(side("object"), ["chunk_id", "__object"], "left")
    return both.select(
        "chunk_id", F.coalesce("subject_name", F.trim("r.subject")).alias("subject"), "subject_type", "subject_key", "r.predicate", F.coalesce("object_name", F.trim("r.object")).alias("object"), "object_type", "object_key",
        "r.evidence", "r.confidence", "r.properties", (F.col("subject_key").isNotNull() & F.col("object_key").isNotNull()).alias("endpoints"),
    )


def graded_relations(proposals: DataFrame, chunks: DataFrame, ontology: DataFrame) -> DataFrame:
    """Proposals with normal predicate, evidence, direction and a status.

    ``proposals`` has (chunk_id, subject, subject_type, predicate, object, object_type, evidence,
    confidence), ``ontology`` (predicate, from_type, to_type), where ``any`` allows every type. Status
    is the first that applies: blank, unknown-predicate, ungrounded, wrong-types, kept. A triple that
    only fits the other way round is turned (flipped). Evidence that is not in the chunk is replaced by
    the shortest sentence that holds both names, if there is one. Null confidence counts 0, others are
    cut to 0..1. Proposals for an unknown chunk are left out.
    """
    p = proposals.withColumn("predicate", predicate_name(F.col("predicate"))).withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)))))
    p = p.join(chunks.select(F.col("id").alias("chunk_id"), F.col("text").alias("__text")), "chunk_id")
    known = F.broadcast(ontology.select(F.col("predicate"), F.lit(True).alias("__known")).distinct())
    rules = ontology.select("predicate", "from_type", "to_type").distinct()
    p = p.join(known, "predicate", "left")
    fit = lambda a, b, out: F.broadcast(rules.select("predicate", F.col("from_type").alias(a), F.col("to_type").alias(b), F.lit(True).alias(out)))
    p = p.join(fit("subject_type", "object_type", "__fits"), ["predicate", "subject_type", "object_type"], "left")
    p = p.join(fit("object_type", "subject_type", "__turned"), ["predicate", "subject_type", "object_type"], "left")
    open_ = F.broadcast(rules.where("from_type = 'any' and to_type = 'any'").select("predicate", F.lit(True).alias("__any")).distinct())
    p = p.join(open_, "predicate", "left")
    grounded = is_grounded(F.col("evidence"), F.col("__text"))
    repaired = repaired_evidence(F.col("__text"), F.array("subject", "object"))
    blank = F.coalesce((F.trim("subject") == "") | (F.trim("object") == "") | F.col("subject").isNull() | F.col("object").isNull(), F.lit(True))
    flip = F.col("__fits").isNull() & F.col("__any").isNull() & F.col("__turned").isNotNull()
    status = (
        F.when(blank, "blank").when(F.col("__known").isNull(), "unknown-predicate").when(~grounded & repaired.isNull(), "ungrounded")
        .when(F.coalesce("__fits", "__any", "__turned").isNull(), "wrong-types").otherwise("kept")
    )
    out = p.withColumn("status", status).withColumn("flipped", flip & (F.col("status") == "kept")).withColumn("repaired", ~grounded & (F.col("status") == "kept"))
    out = out.withColumn("evidence", F.when(grounded, F.col("evidence")).otherwise(repaired))
    swap = lambda a, b: F.when(F.col("flipped"), F.col(b)).otherwise(F.col(a))
    return out.select("chunk_id", swap("subject", "object").alias("subject"), swap("subject_type", "object_type").alias("subject_type"), "predicate", swap("object", "subject").alias("object"), swap("object_type", "subject_type").alias("object_type"), "evidence", "confidence", "status", "flipped", "repaired")


def without_dangling(relations: DataFrame, entities: DataFrame, subject: str = "subject", object_: str = "object", key: str = "key") -> DataFrame:
    """Relations both ends of which are entities."""
    keys = entities.select(key).distinct()
    kept = relations.join(keys.withColumnRenamed(key, subject), subject, "left_semi")
    return kept.join(keys.withColumnRenamed(key, object_), object_, "left_semi")


def remapped(relations: DataFrame, mapping: DataFrame) -> DataFrame:
    """Both ends replaced by their canonical key (old_key, new_key) where there is one; loops on one key are dropped."""
    to = lambda c: mapping.select(F.col("old_key").alias(c), F.col("new_key").alias(f"__{c}"))
    out = relations.join(to("subject"), "subject", "left").join(to("object"), "object", "left")
    out = out.withColumn("subject", F.coalesce("__subject", "subject")).withColumn("object", F.coalesce("__object", "object")).drop("__subject", "__object")
    return out.where("subject <> object")


def merged_triples(relations: DataFrame, place: Column | None = None) -> DataFrame:
    """One row per (subject, predicate, object): mentions, highest confidence, chunks, longest evidence, whether ever flipped.

    ``place`` orders the proposals (chunk id by default): chunks come in that order, and of equally
    long evidence the first is kept.
    """
    at = F.col("chunk_id") if place is None else place
    merged = relations.withColumn("__at", at).groupBy("subject", "predicate", "object").agg(
        F.count("*").alias("mentions"), F.max("confidence").alias("confidence"), F.bool_or("flipped").alias("flipped"),
        F.array_sort(F.collect_set(F.struct("__at", "chunk_id"))).alias("c"),
        F.min(F.struct((-F.length(F.coalesce("evidence", F.lit("")))).alias("n"), "__at", "evidence"))["evidence"].alias("evidence"),
    )
    return merged.withColumn("chunk_ids", F.array_distinct(F.transform("c", lambda x: x["chunk_id"]))).drop("c")


def merged_properties(relations: DataFrame, place: Column | None = None) -> DataFrame:
    """(subject, predicate, object, properties): the maps of equal triples in one; of a property that several give, the first proposal's stays."""
    at = F.col("chunk_id") if place is None else place
    said = relations.select("subject", "predicate", "object", at.alias("__at"), F.explode("properties").alias("name", "value"))
    first = said.groupBy("subject", "predicate", "object", "name").agg(F.min(F.struct("__at", "value"))["value"].alias("value"))
    return first.groupBy("subject", "predicate", "object").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("properties"))


def merged_entities(entities: DataFrame) -> DataFrame:
    """One row per key: mentions added up, first known year, all chunks."""
    return entities.groupBy("key").agg(F.sum("mentions").alias("mentions"), F.min("year").alias("year"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))


def role_clusters(relations: DataFrame, years: DataFrame) -> DataFrame:
    """(key, roles): the predicates that an entity takes part in and ``y:year`` of the works at the other end."""
    ends = relations.select(F.col("subject").alias("key"), "predicate", F.col("object").alias("other")).unionByName(relations.select(F.col("object").alias("key"), "predicate", F.col("subject").alias("other")))
    dated = ends.join(years.select(F.col("key").alias("other"), "year"), "other", "left")
    tokens = dated.select("key", F.explode(F.array_compact(F.array("predicate", F.concat(F.lit("y:"), F.col("year").cast("string"))))).alias("role"))
    return tokens.groupBy("key").agg(F.array_sort(F.collect_set("role")).alias("roles"))


def without_rejected(triples: DataFrame, rejected: DataFrame) -> DataFrame:
    """Triples but for those (subject, predicate, object) that a reviewer rejected before."""
    return triples.join(rejected.select("subject", "predicate", "object").distinct(), ["subject", "predicate", "object"], "left_anti")


def below_floor(triples: DataFrame, floor: float = 0.6) -> DataFrame:
    return triples.withColumn("below_floor", F.col("confidence") < floor)


def verification_batches(triples: DataFrame, size: int = 10) -> DataFrame:
    """Numbers the triples of each first chunk and deals them to batches."""
    order = Window.partitionBy(F.col("chunk_ids")[0]).orderBy("subject", "predicate", "object")
    return triples.withColumn("place", F.row_number().over(order) - 1).withColumn("batch", F.floor(F.col("place") / size).cast("int")).withColumn("index", F.col("place") % size).drop("place")


def with_verdicts(batched: DataFrame, verdicts: DataFrame, partial: float = 0.7) -> DataFrame:
    """Unsupported triples go, partly supported ones keep 0.7 of their confidence; without a verdict all stays.

    ``verdicts`` has (chunk_id, batch, index, verdict).
    """
    v = verdicts.select("chunk_id", "batch", "index", F.upper(F.trim("verdict")).alias("verdict"))
    out = batched.withColumn("chunk_id", F.col("chunk_ids")[0]).join(v, ["chunk_id", "batch", "index"], "left")
    out = out.where("verdict is null or verdict <> 'UNSUPPORTED'")
    return out.withColumn("confidence", F.when(F.col("verdict") == "PARTIAL", F.col("confidence") * partial).otherwise(F.col("confidence")))


def funnel(graded: DataFrame) -> DataFrame:
    """(status, n, flipped, repaired): how many proposals ended where."""
    count = lambda c: F.sum(F.col(c).cast("int")).alias(c)
    return graded.groupBy("status").agg(F.count("*").alias("n"), count("flipped"), count("repaired"))


def metrics(graded: DataFrame, chunks: int | None = None) -> DataFrame:
    """One row of rates over all proposals, with warnings; 0 where there is nothing to divide by.

    grounding and conformance rate, share of flipped and of RELATED_TO among the kept, kept per chunk.
    """
    kept = (F.col("status") == "kept").cast("int")
    some = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    base = graded.agg(F.count("*").alias("n"), F.sum(kept).alias("kept"), some(F.col("status") != "ungrounded").alias("grounded"), some(~F.col("status").isin("unknown-predicate", "wrong-types")).alias("conformant"), some(F.col("flipped")).alias("flipped"), some((F.col("status") == "kept") & (F.col("predicate") == "RELATED_TO")).alias("vague"), F.countDistinct("chunk_id").alias("chunks"))
    over = lambda a, b: F.round(F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0)), 6)
    out = base.select("n", "kept", over("grounded", "n").alias("grounding_rate"), over("conformant", "n").alias("conformance_rate"), over("flipped", "kept").alias("flip_rate"), over("vague", "kept").alias("vague_rate"), over("kept", "chunks").alias("kept_per_chunk"))
    warn = F.array_compact(F.array(F.when(F.col("vague_rate") > 0.2, F.lit("vague")), F.when(F.col("flip_rate") > 0.15, F.lit("flipped")), F.when(F.col("grounding_rate") < 0.7, F.lit("ungrounded"))))
    return out.withColumn("warnings", F.array_join(warn, " "))


def committed(triples: DataFrame, stored: DataFrame) -> DataFrame:
    """``stored`` edges with those of the documents in ``triples`` replaced, so a commit can be repeated.

    Both have (doc_id, subject, predicate, object, confidence, mentions, evidence, chunk_ids). Equal triples
    of a document are one edge: highest confidence, mentions added up, the longest evidence, all chunks in order.
    """
    cols = ["doc_id", "subject", "predicate", "object", "confidence", "mentions", "evidence", "chunk_ids"]
    kept = stored.select(*cols).join(triples.select("doc_id").distinct(), "doc_id", "left_anti")
    keys = cols[:4]
    one = triples.groupBy(*keys).agg(F.max("confidence").alias("confidence"), F.sum("mentions").alias("mentions"), F.min(F.struct((-F.length(F.coalesce("evidence", F.lit("")))).alias("n"), "evidence"))["evidence"].alias("evidence"))
    read = triples.select(*keys, F.explode("chunk_ids").alias("c")).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("c")).alias("chunk_ids"))
    fresh = one.join(read, keys, "left").withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<string>")))
    return kept.select(*cols).unionByName(fresh.select(*cols))
