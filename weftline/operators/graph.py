"""Property-graph operators over two tables.

Entities are (doc_id, key, type, name, year, mentions, aliases); edges are (doc_id, subject, predicate,
object, confidence, mentions, derived, chunk_ids).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from weftline.plans.runtime import cut_lineage

#: Persons of a work up to which they meet in one task, and the blocks that larger ones are dealt to.
CAST, CAST_BLOCKS = 2048, 64
#: Meetings of two keys on a work that are counted at once, and pairs that go on in one batch.
MEETINGS, PAIRS = 2_000_000, 100_000
#: Predicates that tie a person to a work; the first five run from person to work, the others back.
CREDITS_OUT = ["ACTED_IN", "DIRECTED", "WROTE", "PRODUCED", "COMPOSED_FOR"]
CREDITS_BACK = ["SHOT_BY", "EDITED_BY"]
#: How a step of a path reads from subject to object and the other way round.
VERBS = {
    "ACTED_IN": ("acted in", "starred"),
    "DIRECTED": ("directed", "was directed by"),
    "WROTE": ("wrote", "was written by"),
    "PRODUCED": ("produced", "was produced by"),
    "COMPOSED_FOR": ("composed for", "was scored by"),
    "SHOT_BY": ("was shot by", "shot"),
    "EDITED_BY": ("was edited by", "edited"),
    "PLAYED": ("played", "was played by"),
}


def live_edges(edges: DataFrame, min_confidence: float = 0.6, derived: bool = True) -> DataFrame:
    """Edges at or above the confidence, with or without derived ones."""
    kept = edges.where(F.col("confidence") >= min_confidence)
    return kept if derived else kept.where(~F.col("derived"))


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge from both of its ends: (doc_id, here, there, predicate, forward)."""
    out = edges.select("doc_id", F.col("subject").alias("here"), F.col("object").alias("there"), "predicate", F.lit(True).alias("forward"))
    return out.unionByName(edges.select("doc_id", F.col("object").alias("here"), F.col("subject").alias("there"), "predicate", F.lit(False).alias("forward")))


def titles(column: str, most: int) -> Column:
    return F.array_join(F.slice(F.array_sort(F.collect_set(column)), 1, most), " · ")


def works_by_studio(edges: DataFrame, entities: DataFrame, year: int | None = None, min_confidence: float = 0.6) -> DataFrame:
    """(studio, films, titles): distinct works produced by each studio, eight titles in order, most works first."""
    made = live_edges(edges, min_confidence).where("predicate = 'PRODUCED_BY'").select("doc_id", F.col("subject").alias("work"), F.col("object").alias("key"))
    work = entities.select("doc_id", F.col("key").alias("work"), F.col("name").alias("title"), F.col("year").alias("work_year"))
    work = work if year is None else work.where(F.col("work_year") == year)
    named = made.join(work, ["doc_id", "work"]).join(entities.select("doc_id", "key", F.col("name").alias("studio")), ["doc_id", "key"])
    return named.groupBy("studio").agg(F.countDistinct("work").alias("films"), titles("title", 8).alias("titles")).orderBy(F.desc("films"), "studio")


def shared_credits(edges: DataFrame, first: str, second: str, min_confidence: float = 0.6) -> DataFrame:
    """(first_key, second_key, works): distinct works that a pair shares, through two predicates that lead to or from the work.

    ``first`` runs from the person to the work, ``second`` from the work to the person. Meetings on a work are many more than
    edges, so they are never shuffled: the edges of each side are packed to blocks by key, and each block of one side meets each of
    the other in a task that counts whole pairs. What is written grows with the edges only; the lists of one work are one row.
    """
    live = live_edges(edges, min_confidence)
    side = lambda predicate, work, key, name: live.where((F.col("predicate") == predicate) & F.col("doc_id").isNotNull()).select(F.col(work).alias("work"), F.struct("doc_id", F.col(key).alias("key")).alias("x")).groupBy("work").agg(F.collect_set("x").alias(name))
    met = side(first, "object", "subject", "a").join(side(second, "subject", "object", "b"), "work")
    blocks = math.ceil(2 * math.sqrt(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    lists = F.struct(F.array_distinct(F.col("a.key")).alias("a"), F.array_distinct(F.col("b.key")).alias("b"))
    # of a work in several documents each first key meets what its own documents have, once
    tied = lambda k: F.filter("b", lambda y: F.exists("a", lambda x: (x["doc_id"] == y["doc_id"]) & x["key"].eqNullSafe(k)))
    apart = F.transform(lists["a"], lambda k: F.struct(F.array(k).alias("a"), F.array_distinct(F.transform(tied(k), lambda y: y["key"])).alias("b")))
    several = F.size(F.array_distinct(F.concat("a.doc_id", "b.doc_id"))) > 1
    rows = met.select(F.explode(F.when(several, apart).otherwise(F.array(lists))).alias("r")).select("r.a", "r.b", F.monotonically_increasing_id().alias("at"))
    ends = lambda c, right: F.transform(c, lambda k: F.struct(F.lit(right).alias("right"), k.alias("key")))
    ends = rows.select("at", F.explode(F.concat(ends("a", False), ends("b", True))).alias("e")).select("at", "e.right", "e.key")
    dealt = ends.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).repartitionById(blocks, F.col("block"))
    packed = cut_lineage(dealt.select("right", "at", "key").mapInArrow(_packed, "a binary, b binary"))
    kinds = [StructField(f"{n}_key", live.schema[c].dataType) for n, c in (("first", "subject"), ("second", "object"))]
    both = packed.where("a is not null").select("a").crossJoin(packed.where("b is not null").select("b").hint("shuffle_replicate_nl"))
    return both.mapInArrow(_meetings, StructType([*kinds, StructField("works", LongType(), False)]))


def _bytes(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (a, b) for all rows (right, at, key): each side's keys, and its entries (at, place of the key) in order of ``at``."""
    held: dict[bool, list[tuple[np.ndarray, pa.Array]]] = {False: [], True: []}
    kind = None
    for batch in batches:
        right, kind = batch.column(0).to_numpy(zero_copy_only=False), batch.schema.field(2).type
        for side, own in held.items():
            at = np.flatnonzero(right == side)
            if len(at):
                own.append((batch.column(1).to_numpy()[at], batch.column(2).take(pa.array(at)).dictionary_encode(null_encoding="encode")))
    packed = []
    for own in held.values():
        if not own:
            packed.append(None)
            continue
        keys = pa.chunked_array([k for _, k in own]).unify_dictionaries().combine_chunks()
        keys = keys if isinstance(keys, pa.DictionaryArray) else keys.chunk(0)
        at, place = np.concatenate([x for x, _ in own]), keys.indices.to_numpy()
        order = np.argsort(at, kind="stable")
        entries = pa.table({"step": np.diff(at[order], prepend=0), "place": place[order].astype(np.int32)})
        packed.append(_bytes(pa.table({"keys": keys.dictionary})) + _bytes(entries))
    if kind is not None:
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in packed], ["a", "b"])


def _unpacked(held: pa.Scalar) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    source = pa.BufferReader(held.as_buffer())
    keys, entries = (pa.ipc.open_stream(source).read_all() for _ in range(2))
    return keys.column(0).combine_chunks(), np.cumsum(entries.column(0).to_numpy()), entries.column(1).to_numpy()


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first_key, second_key, works) of each two packed blocks; the entries of a first key are counted together."""
    for batch in batches:
        for i in range(batch.num_rows):
            a_keys, a_at, a = _unpacked(batch.column(0)[i])
            b_keys, b_at, b = _unpacked(batch.column(1)[i])
            starts = np.searchsorted(b_at, a_at, "left")
            number = np.searchsorted(b_at, a_at, "right") - starts
            order = np.argsort(a, kind="stable")
            order = order[number[order] > 0]
            a, starts, number = a[order].astype(np.int64), starts[order], number[order]
            done = np.cumsum(number)
            first = np.flatnonzero(np.diff(a, prepend=-1))  # where the next first key begins
            before = np.append(done[first] - number[first], done[-1:])
            at = 0
            while at < len(first):
                end = max(at + 1, int(np.searchsorted(before, before[at] + MEETINGS, "right")) - 1)
                lo, hi = first[at], first[end] if end < len(first) else len(a)
                n = number[lo:hi]
                place = np.arange(n.sum()) + np.repeat(starts[lo:hi] - (np.cumsum(n) - n), n)
                pair = np.sort(np.repeat(a[lo:hi] * len(b_keys), n) + b[place])
                new = np.flatnonzero(np.diff(pair, prepend=-1))
                works = np.diff(new, append=len(pair))
                x, y = np.divmod(pair[new], len(b_keys))
                for j in range(0, len(new), PAIRS):
                    part = slice(j, j + PAIRS)
                    yield pa.RecordBatch.from_arrays([a_keys.take(pa.array(x[part])), b_keys.take(pa.array(y[part])), pa.array(works[part])], ["first_key", "second_key", "works"])
                at = end


def members_of_several(edges: DataFrame, member: str, group: str, min_confidence: float = 0.6) -> DataFrame:
    """(key, groups, names): who is tied by ``member`` to works of two groups or more, by the predicate ``group`` of the works."""
    live = live_edges(edges, min_confidence)
    a = live.where(F.col("predicate") == member).select("doc_id", F.col("subject").alias("key"), F.col("object").alias("work"))
    b = live.where(F.col("predicate") == group).select("doc_id", F.col("subject").alias("work"), F.col("object").alias("grp"))
    both = a.join(b, ["doc_id", "work"]).select("key", "grp").distinct()
    return both.groupBy("key").agg(F.count("*").alias("groups"), F.array_join(F.array_sort(F.collect_list("grp")), " · ").alias("names")).where("groups > 1")


def tally_by_first(edges: DataFrame, won: str, owner: str, min_confidence: float = 0.6) -> DataFrame:
    """(key, awards): edges ``won`` of works counted for the first (smallest key) owner of each work."""
    live = live_edges(edges, min_confidence)
    first = live.where(F.col("predicate") == owner).groupBy("doc_id", F.col("subject").alias("work")).agg(F.min("object").alias("key"))
    wins = live.where(F.col("predicate") == won).select("doc_id", F.col("subject").alias("work"))
    return wins.join(first, ["doc_id", "work"]).groupBy("key").agg(F.count("*").alias("awards"))


PRESETS = ("studio-film-count", "director-cinematographer-pairs", "multi-franchise-actors", "award-tally-by-studio")


def aggregate(preset: str, edges: DataFrame, entities: DataFrame, year: int | None = None, min_confidence: float = 0.6) -> DataFrame:
    """One of the PRESETS by its name; an unknown name is an error. Rows come with the largest figure first, ties by name."""
    if preset == "studio-film-count":
        return works_by_studio(edges, entities, year, min_confidence)
    if preset == "director-cinematographer-pairs":
        return shared_credits(edges, "DIRECTED", "SHOT_BY", min_confidence).orderBy(F.desc("works"), "first_key", "second_key")
    if preset == "multi-franchise-actors":
        return members_of_several(edges, "ACTED_IN", "PART_OF_FRANCHISE", min_confidence).orderBy(F.desc("groups"), "key")
    if preset == "award-tally-by-studio":
        return tally_by_first(edges, "WON", "PRODUCED_BY", min_confidence).orderBy(F.desc("awards"), "key")
    raise ValueError(f"unknown preset {preset}; known are {', '.join(PRESETS)}")


def edge(edges: DataFrame, subject: str, predicate: str, object_: str) -> DataFrame:
    """The edge between two keys, of any confidence, derived or not."""
    return edges.where((F.col("subject") == subject) & (F.col("predicate") == predicate) & (F.col("object") == object_)).limit(1)


def endpoints(questions: DataFrame, entities: DataFrame, kind: str = "Person") -> DataFrame:
    """(question_id, from_key, to_key): the two longest names of a type that stand in the question, whatever the case; null where fewer do.

    Parts of the question of each length that names have are joined to the names, so no question meets every name.
    """
    names = entities.where((F.col("type") == kind) & (F.length("name") > 0)).select("key", F.lower("name").alias("part"))
    sizes = names.agg(F.collect_set(F.length("part"))).scalar()
    low = questions.select("question_id", F.lower("question").alias("q")).withColumn("n", F.explode(sizes)).where("n <= length(q)")
    parts = low.select("question_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("q") - F.col("n") + 1), lambda i: F.substring("q", i, F.col("n"))))).alias("part"))
    met = parts.join(names, "part").withColumn("r", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc(F.length("part")), "key"))).where("r <= 2")
    two = met.groupBy("question_id").agg(F.max(F.when(F.col("r") == 1, F.col("key"))).alias("from_key"), F.max(F.when(F.col("r") == 2, F.col("key"))).alias("to_key"))
    return questions.select("question_id").distinct().join(two, "question_id", "left")


def collaborations(edges: DataFrame, entities: DataFrame, least: int = 1, out: list[str] | None = None, back: list[str] | None = None, kind: str = "Person") -> DataFrame:
    """(doc_id, a, b, shared, titles): pairs of persons with works in common, a < b; all confidences count.

    The pairs meet on the work; a work of more than CAST persons is dealt to CAST_BLOCKS blocks of them, so it
    fills no task. Titles are the five smallest.
    """
    out, back = CREDITS_OUT if out is None else out, CREDITS_BACK if back is None else back
    tied = edges.where(F.col("predicate").isin(out)).select("doc_id", F.col("subject").alias("who"), F.col("object").alias("work"))
    tied = tied.unionByName(edges.where(F.col("predicate").isin(back)).select("doc_id", F.col("object").alias("who"), F.col("subject").alias("work"))).distinct()
    people = entities.where(F.col("type") == kind).select("doc_id", F.col("key").alias("who"))
    tied = cut_lineage(tied.join(people, ["doc_id", "who"], "left_semi"))
    work = entities.select("doc_id", F.col("key").alias("work"), F.col("name").alias("title"))
    title = work.groupBy("doc_id", "work").agg(F.min("title").alias("title"))
    met = tied.groupBy("doc_id", "work").agg(F.count("*").alias("n")).where("n > 1").join(title, ["doc_id", "work"], "left")
    met = cut_lineage(met)
    few = tied.join(met.where(F.col("n") <= CAST), ["doc_id", "work"]).select("doc_id", "work", "title", F.col("who").alias("a"))
    pairs = few.join(few.select("doc_id", "work", F.col("a").alias("b")), ["doc_id", "work"]).where("a < b").select("doc_id", "title", "a", "b")
    large = met.where(F.col("n") > CAST)
    if not large.isEmpty():
        hub = tied.join(large.select("doc_id", "work", "title"), ["doc_id", "work"]).withColumn("block", F.pmod(F.xxhash64("who"), F.lit(CAST_BLOCKS)).cast("int"))
        dealt = hub.select("doc_id", "work", "title", F.col("who").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(CAST_BLOCKS - 1))).alias("block"))
        many = dealt.join(hub.select("doc_id", "work", "block", F.col("who").alias("b")), ["doc_id", "work", "block"]).where("a < b")
        pairs = pairs.unionByName(many.select("doc_id", "title", "a", "b"))
    shared = pairs.groupBy("doc_id", "a", "b").agg(F.count("*").alias("shared"), titles("title", 5).alias("titles"))
    return shared.where(F.col("shared") >= least)


def derived_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with all earlier derived ones replaced by collaborations of confidence 1."""
    own = edges.where(~F.col("derived"))
    made = collaborations(own, entities).select("doc_id", F.col("a").alias("subject"), F.lit("COLLABORATED_WITH").alias("predicate"), F.col("b").alias("object"), F.lit(1.0).alias("confidence"), F.col("shared").cast("bigint").alias("mentions"), F.lit(True).alias("derived"), F.array().cast("array<string>").alias("chunk_ids"))
    return own.select(made.columns).withColumn("mentions", F.col("mentions").cast("bigint")).unionByName(made)


def expand(seeds: DataFrame, chunks: DataFrame, mentions: DataFrame, edges: DataFrame, min_confidence: float = 0.6, derived: bool = True, related: int = 6, along: bool = True, mentioned: bool = True, tied: bool = True) -> DataFrame:
    """One row per seed chunk: (chunk_id, previous_id, next_id, entities, edges, related_ids).

    ``chunks`` has (doc_id, id, strategy, strategy_ordinal), ``mentions`` (doc_id, chunk_id, entity_key).
    ``edges`` of the result counts the live edges at the chunk's entities; related chunks mention an
    entity at the other end of one, the most frequent six, ties by id. Seeds without a chunk are left out.
    ``along``, ``mentioned`` and ``tied`` switch the hops to neighbours, to entities and through edges; what is off is null or 0.
    """
    order = Window.partitionBy("doc_id", "strategy").orderBy("strategy_ordinal", "id")
    chain = chunks.select("doc_id", F.col("id").alias("chunk_id"), F.lag("id").over(order).alias("previous_id"), F.lead("id").over(order).alias("next_id"))
    base = chain.join(seeds.select("chunk_id").distinct(), "chunk_id", "left_semi")
    held = mentions.distinct().join(seeds.select("chunk_id").distinct(), "chunk_id", "left_semi")
    per = held.groupBy("doc_id", "chunk_id").agg(F.array_join(F.array_sort(F.collect_set("entity_key")), " ").alias("entities"))
    both = undirected(live_edges(edges, min_confidence, derived))
    touched = held.withColumnRenamed("entity_key", "here").join(both, ["doc_id", "here"])
    number = touched.groupBy("doc_id", "chunk_id").agg(F.countDistinct(F.least("here", "there"), F.greatest("here", "there"), "predicate").alias("edges"))
    far = touched.select("doc_id", "chunk_id", F.col("there").alias("entity_key")).distinct().join(mentions.distinct().withColumnRenamed("chunk_id", "other"), ["doc_id", "entity_key"]).where("other <> chunk_id")
    ranked = far.groupBy("doc_id", "chunk_id", "other").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "chunk_id").orderBy(F.desc("n"), "other"))).where(F.col("r") <= related)
    others = ranked.groupBy("doc_id", "chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "other"))), lambda x: x["other"]), " ").alias("related_ids"))
    out = base.join(per, ["doc_id", "chunk_id"], "left").join(number, ["doc_id", "chunk_id"], "left").join(others, ["doc_id", "chunk_id"], "left")
    on = lambda flag, c: F.col(c) if flag else F.lit(None).cast("string").alias(c)
    number = F.coalesce("edges", F.lit(0)) if tied else F.lit(0).cast("bigint")
    return out.select("chunk_id", on(along, "previous_id"), on(along, "next_id"), on(mentioned, "entities"), number.alias("edges"), on(tied, "related_ids"))


def reach(edges: DataFrame, sources: DataFrame, max_hops: int = 6, target: str | None = None, ways: bool = False) -> DataFrame:
    """(source, key, hops, parent[, way]): every node within ``max_hops`` undirected steps of each source, by levels.

    ``edges`` has (a, b), ``sources`` (key). The parent of a node is the smallest of the level before;
    each level is a join of the frontier with the edges and an anti-join with what is known, written
    to the checkpoint folder, so the plan does not grow. The loop ends early when a level is empty or
    the target is found. ``way`` are the keys from the source to the parent.
    """
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null and a <> b").distinct())
    known = cut_lineage(sources.where("key is not null").select(F.col("key").alias("source"), "key", F.lit(0).alias("hops"), F.lit(None).cast("string").alias("parent"), F.array().cast("array<string>").alias("way")).distinct())
    for hop in range(1, max(1, min(20, max_hops)) + 1):
        met = known.where(F.col("hops") == hop - 1).join(both, F.col("key") == F.col("a"))
        on = F.concat("way", F.array("key")) if ways else F.col("way")  # empty where ways are not asked for
        step = met.groupBy("source", F.col("b").alias("key")).agg(F.min(F.struct("a", on.alias("way"))).alias("from"))
        fresh = cut_lineage(step.join(known, ["source", "key"], "left_anti").select("source", "key", F.lit(hop).alias("hops"), F.col("from.a").alias("parent"), "from.way"))
        if fresh.isEmpty():
            break
        known = known.unionByName(fresh)
        if target is not None and not fresh.where(F.col("key") == target).isEmpty():
            break
    return known if ways else known.drop("way")


def shortest_path(edges: DataFrame, start: str, end: str, max_hops: int = 6) -> DataFrame:
    """(hop, key) along the shortest path from start to end; no rows if there is none, or if both are one.

    Each node found carries the keys on the way to it (``max_hops`` at most), so the path of the end is read off its row.
    """
    spark = edges.sparkSession
    if start == end:
        return spark.createDataFrame([], "hop int, key string")
    tree = reach(edges, spark.createDataFrame([(start,)], "key string"), max_hops, end, ways=True)
    return tree.where(F.col("key") == end).select(F.posexplode(F.concat("way", F.array("key"))).alias("hop", "key"))


def path_steps(path: DataFrame, edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(hop, here, predicate, forward, there, here_year, there_year, here_is_work) between the keys of ``path`` (hop, key).

    Of several edges between two keys one of a credit counts first, then the smallest predicate; a step against the edge's
    direction is not forward. Names come from ``entities``, a key without one stands for itself; only films have years.
    """
    ends = path.select("hop", F.col("key").alias("a")).join(path.select((F.col("hop") - 1).alias("hop"), F.col("key").alias("b")), "hop")
    both = undirected(edges).select(F.col("here").alias("a"), F.col("there").alias("b"), "predicate", "forward")
    credit = (~F.col("predicate").isin(CREDITS_OUT + CREDITS_BACK)).cast("int").alias("c")
    tied = both.join(F.broadcast(ends), ["a", "b"]).groupBy("hop", "a", "b").agg(F.min(F.struct(credit, "predicate", F.col("forward").alias("f"))).alias("e"))
    name = lambda c: entities.select(F.col("key").alias(c), F.col("name").alias(f"{c}_name"), F.when(F.col("type") == "Film", F.col("year")).alias(f"{c}_year"), F.col("type").isin("Film", "TVSeries").alias(f"{c}_work")).dropDuplicates([c])
    told = tied.join(name("a"), "a", "left").join(name("b"), "b", "left")
    return told.select((F.col("hop") + 1).alias("hop"), F.coalesce("a_name", "a").alias("here"), F.col("e.predicate").alias("predicate"), F.col("e.f").alias("forward"), F.coalesce("b_name", "b").alias("there"), F.col("a_year").alias("here_year"), F.col("b_year").alias("there_year"), F.coalesce("a_work", F.lit(False)).alias("here_is_work"))


def told_path(steps: DataFrame) -> DataFrame:
    """(narrative) of :func:`path_steps`, one row."""
    inner = [c for c in steps.columns if c != "hop"]
    ordered = F.array_sort(F.collect_list(F.struct("hop", F.struct(*inner).alias("s"))))
    return steps.agg(F.transform(ordered, lambda x: x["s"]).alias("steps")).where("size(steps) > 0").select(narrative(F.col("steps")).alias("narrative"))


def narrative(steps: Column) -> Column:
    """A sentence from an array of (here, predicate, forward, there, here_year, there_year, here_is_work) steps.

    Years are given for films only. Each further step goes on with which (a work) or who (a person).
    """
    table = F.create_map(*[F.lit(x) for p, (v, w) in VERBS.items() for x in (f"{p}>", v, f"{p}<", w)])
    plain = lambda s: F.when(s["forward"], F.lower(F.replace(s["predicate"], F.lit("_"), F.lit(" ")))).otherwise("is linked to")
    verb = lambda s: F.coalesce(table[F.concat(s["predicate"], F.when(s["forward"], ">").otherwise("<"))], plain(s))
    label = lambda s, end: F.concat(s[end], F.coalesce(F.concat(F.lit(" ("), s[f"{end}_year"].cast("string"), F.lit(")")), F.lit("")))
    opening = lambda s, i: F.when(i == 0, label(s, "here")).when(s["here_is_work"], F.lit("which")).otherwise(F.lit("who"))
    return F.concat(F.array_join(F.transform(steps, lambda s, i: F.concat_ws(" ", opening(s, i), verb(s), label(s, "there"))), ", "), F.lit("."))


def snapshot(edges: DataFrame, limit: int = 400, min_confidence: float = 0.6, derived: bool = True) -> DataFrame:
    """The first edges by key, with the number of all and whether some are missing."""
    live = live_edges(edges, min_confidence, derived)
    shown = live.orderBy("doc_id", "subject", "predicate", "object").limit(max(1, min(3000, limit)))
    return shown.withColumn("total", live.agg(F.count("*")).scalar()).withColumn("truncated", F.col("total") > limit)


def snapshot_nodes(shown: DataFrame, entities: DataFrame) -> DataFrame:
    """The entities that the edges of a snapshot touch."""
    ends = shown.select("doc_id", F.col("subject").alias("key")).unionByName(shown.select("doc_id", F.col("object").alias("key"))).distinct()
    return entities.join(ends, ["doc_id", "key"], "left_semi")


def find_entities(entities: DataFrame, kind: str | None = None, part: str | None = None, limit: int = 100) -> DataFrame:
    """Entities of a type whose name contains a text, whatever the case; most mentioned first, then by name."""
    out = entities
    if kind is not None:
        out = out.where(F.lower("type") == kind.lower())
    if part is not None:
        out = out.where(F.contains(F.lower("name"), F.lit(part.lower())))
    return out.orderBy(F.desc("mentions"), F.lower("name"), "doc_id", "key").limit(max(1, min(1000, limit)))


def edge_evidence(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """(subject, predicate, object, chunk_id, text): the chunks that an edge was read from."""
    said = edges.select("doc_id", "subject", "predicate", "object", F.explode("chunk_ids").alias("chunk_id"))
    return said.join(chunks.select(F.col("id").alias("chunk_id"), "text"), "chunk_id")


def duplicate_keys(entities: DataFrame) -> DataFrame:
    """Keys that break uniqueness: more than one row in a document."""
    return entities.groupBy("doc_id", "key").count().where("count > 1")
