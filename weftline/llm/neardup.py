"""Near-duplicate texts by min-max hashing: both the minimum and the maximum of each permutation are kept.

The elements of a text are its words with their running number (the second "the" is an element of
its own), without the words that a fifth of all texts hold: those are what unlike texts share. Half
as many permutations as signature values are evaluated; bands of five values are buckets. Texts are
known by the hash of their content from the start, and each task sends a content once, so copies
collapse before anything is shuffled. Pairs out of buckets are first held against sketches, two bits of
each value of the signature, and what is likely alike is checked exactly on the texts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.components import connected_groups
from weftline.plans.runtime import cut_lineage

WORD = re.compile(r"[a-z0-9]+")
BANDS, ROWS = 96, 5
PERMUTATIONS = BANDS * ROWS // 2
#: A word is common if this share of all texts, and this many of them, hold it; at most 5 x the words of a text are.
COMMON_SHARE, COMMON_LEAST = 0.2, 100
#: With fewer uncommon elements than this, or than a fifth of the words, a text also enters the buckets of all its elements.
FEW = 24
#: Ids of a bucket that one row carries on; larger buckets become several rows of pairs of blocks.
BLOCK = 128
#: Values of the signature of which two bits must agree: 0.4 of the elements in common are expected to give these. Pairs that
#: count have 0.53 at the least, 311 agreeing values expected with a standard deviation of 10.
AGREEING = 264
#: Contents of likely pairs up to which their hashes (8 MB) are broadcast; beyond it their texts are found by a shuffle.
BROADCAST_ENDS = 1_000_000
#: Pairs of one content that a task is given; contents with more than this, and than this share of all pairs (so 10,000 at most), are dealt to several.
HOT_PAIRS, HOT_SHARE = 512, 1e-4

_rng = np.random.default_rng(20240501)
_A = (_rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)


def _code(word: str) -> int:
    return zlib.crc32(word.encode()) ^ (zlib.adler32(word.encode()) * 0x9E3779B1 & 0xFFFFFFFF)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts = 0
    seen: Counter = Counter()
    for batch in batches:
        for t in batch.column(0).to_pylist():
            texts += 1
            seen.update(set(WORD.findall(t.lower())))
        if len(seen) > 500_000:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen = Counter()
    yield pa.RecordBatch.from_arrays([pa.array([*seen, ""], pa.string()), pa.array([*seen.values(), texts], pa.int64())], ["word", "n"])


def common_words(texts: DataFrame) -> list[str]:
    """The words in COMMON_SHARE of all texts; a bounded list, from counts over every text."""
    counts = cut_lineage(texts.select("text").mapInArrow(_word_counts, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.where("word = ''").agg(F.sum("n")).first()[0] or 0
    least = max(COMMON_LEAST, COMMON_SHARE * total)
    return sorted(r[0] for r in counts.where((F.col("word") != "") & (F.col("n") >= least)).select("word").collect())


def elements(codes: np.ndarray) -> np.ndarray:
    """A 32-bit number per (word, running number) of the words given as 32-bit codes."""
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    at = np.arange(len(ranked))
    nth = at - np.maximum.accumulate(np.where(fresh, at, 0))
    x = ranked + nth.astype(np.uint32) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def extremes(x: np.ndarray) -> np.ndarray:
    """Minima, then maxima, of a set of elements under each permutation."""
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    high = np.zeros(PERMUTATIONS, np.uint32)
    for at in range(0, len(x), 4096):
        h = x[at : at + 4096, None] * _A + _B
        np.minimum(low, h.min(0), out=low)
        np.maximum(high, h.max(0), out=high)
    return np.concatenate([low, high])


def signature(x: np.ndarray) -> np.ndarray:
    """BANDS bucket numbers of a set of elements, five extremes to a band."""
    out = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for row in extremes(x).astype(np.uint64).reshape(ROWS, BANDS):
        out = (out ^ row) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(28)
    return out


def sketch(x: np.ndarray) -> bytes:
    """Two bits of every extreme of a set of elements."""
    two = (extremes(x) * np.uint32(0x9E3779B1)) >> np.uint32(30)
    return np.packbits(np.stack([two >> 1, two & 1], 1).astype(np.uint8).ravel()).tobytes()


#: Number of pairs of bits that are 0 in a byte.
_EQUAL = np.array([sum((v >> i) & 3 == 0 for i in (0, 2, 4, 6)) for v in range(256)], np.int64)


def agreeing(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Number of extremes on whose two bits the sketches of each pair agree; -1 where one is missing."""
    out = np.full(len(a), -1, np.int64)
    both = np.flatnonzero(a.is_valid().to_numpy(zero_copy_only=False) & b.is_valid().to_numpy(zero_copy_only=False))
    if len(both):
        x, y = (np.frombuffer(b"".join(c.take(pa.array(both)).to_pylist()), np.uint8).reshape(len(both), -1) for c in (a, b))
        out[both] = _EQUAL[x ^ y].sum(1)
    return out


def _described(batches: Iterator[pa.RecordBatch], common: list[str], least_words: int, describe) -> Iterator[tuple[list[int], list]]:
    """(uids, descriptions) per batch (uid, text, kind); ``describe`` gets kind, uncommon elements and, if those are few, all; a task describes a content once."""
    known: dict[str, tuple[int, bool]] = {}
    skip = set(common)
    sent: set[int] = set()
    for batch in batches:
        uids: list[int] = []
        found: list = []
        for uid, t, kind in zip(*(batch.column(c).to_pylist() for c in range(3))):
            if uid in sent:
                continue
            if len(sent) >= 2_000_000:
                sent = set()
            sent.add(uid)
            words = WORD.findall(t.lower())
            if len(words) < least_words:
                continue
            if len(known) > 500_000:
                known = {}
            pairs = []
            for w in words:
                k = known.get(w)
                if k is None:
                    k = known[w] = (_code(w), w not in skip)
                pairs.append(k)
            codes = np.fromiter((c for c, _ in pairs), np.uint32, len(pairs))
            rare = np.fromiter((r for _, r in pairs), bool, len(pairs))
            n = int(rare.sum())
            uids.append(uid)
            found.append(describe(kind, elements(codes[rare]) if n else None, elements(codes) if n < FEW or n * 5 < len(words) else None))
        if uids:
            yield uids, found


def _buckets(common: list[str], least_words: int):
    def describe(kind: str, rare: np.ndarray | None, every: np.ndarray | None) -> np.ndarray:
        apart = np.uint64(zlib.crc32(kind.encode()))  # kinds share no bucket
        return np.concatenate(([signature(rare) ^ apart] if rare is not None else []) + ([~signature(every) ^ apart] if every is not None else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uids, buckets in _described(batches, common, least_words, describe):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(buckets).view(np.int64)), pa.array(np.repeat(np.array(uids, np.int64), [len(b) for b in buckets]))], ["bucket", "uid"])

    return run


def _sketches(common: list[str], least_words: int):
    def describe(_: str, rare: np.ndarray | None, every: np.ndarray | None) -> tuple[bytes | None, bytes | None]:
        return tuple(None if x is None else sketch(x) for x in (rare, every))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uids, found in _described(batches, common, least_words, describe):
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), *(pa.array(c, pa.binary()) for c in zip(*found))], ["uid", "rare", "every"])

    return run


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose sketches agree, of uncommon or of all elements."""
    for b in batches:
        keep = pa.array(np.flatnonzero((agreeing(b.column(2), b.column(4)) >= AGREEING) | (agreeing(b.column(3), b.column(5)) >= AGREEING)))
        yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep)], ["a", "b"])


def hot_contents(pairs: DataFrame, side: str, hot_pairs: int) -> DataFrame:
    """(__hot, parts): contents with more than ``hot_pairs`` pairs on a side, and HOT_SHARE of all pairs, and the parts their pairs are dealt to; few enough to broadcast."""
    least = F.greatest(F.lit(float(hot_pairs)), pairs.agg(F.count("*") * F.lit(HOT_SHARE)).scalar())
    return pairs.groupBy(F.col(side).alias("__hot")).agg(F.count("*").alias("n")).where(F.col("n") > least).select("__hot", F.ceil(F.col("n") / least).cast("int").alias("parts"))


def with_sketch(pairs: DataFrame, sketches: DataFrame, side: str, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``pairs`` with the sketches (one row per uid) of ``side`` as r<side> and e<side>; those of contents with very many partners are broadcast."""
    own = sketches.select(F.col("uid").alias(side), F.col("rare").alias(f"r{side}"), F.col("every").alias(f"e{side}"))
    hot = cut_lineage(hot_contents(pairs, side, hot_pairs).select(F.col("__hot").alias(side)))
    if hot.isEmpty():
        return pairs.join(own, side)
    rest = pairs.join(F.broadcast(hot), side, "left_anti").join(own, side)
    return rest.unionByName(pairs.join(F.broadcast(own.join(F.broadcast(hot), side, "left_semi")), side))


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket of two contents or more: rows (these, those) whose elements are to be paired."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    bucket, uid = (np.concatenate(c) for c in zip(*held))
    order = np.lexsort((uid, bucket))
    bucket, uid = bucket[order], uid[order]
    fresh = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (uid[1:] != uid[:-1])])
    bucket, uid = bucket[fresh], uid[fresh]
    start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    size = np.diff(np.concatenate([start, [len(bucket)]]))
    these: list[np.ndarray] = []
    those: list[np.ndarray] = []
    schema = pa.schema([("these", pa.list_(pa.int64())), ("those", pa.list_(pa.int64()))])
    for s, n in zip(start[size > 1].tolist(), size[size > 1].tolist()):
        blocks = [uid[s + i : s + min(n, i + BLOCK)] for i in range(0, n, BLOCK)]
        for i, a in enumerate(blocks):
            for b in blocks[i:]:
                these.append(a)
                those.append(b)
                if len(these) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(these, schema[0].type), pa.array(those, schema[1].type)], schema=schema)
                    these, those = [], []
    if these:
        yield pa.RecordBatch.from_arrays([pa.array(these, schema[0].type), pa.array(those, schema[1].type)], schema=schema)


def common_words_of(a: Counter, b: Counter) -> int:
    """Number of common words, each as often as in both."""
    if len(b) < len(a):
        a, b = b, a
    get = b.get
    return sum(min(n, get(w, 0)) for w, n in a.items())


def _verified(least_words: int, num: int, den: int):
    """Keeps the pairs with 2 * common / (words of both) >= num / den, in whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags: dict[int, tuple[Counter, int]] = {}

        def bag(uid: int, text: str) -> tuple[Counter, int]:
            got = bags.get(uid)
            if got is None:
                if len(bags) > 5000:
                    bags.clear()
                words = WORD.findall(text.lower())
                got = bags[uid] = (Counter(words), len(words))
            return got

        for batch in batches:
            keep, like = [], []
            ua, ub, ta, tb = (batch.column(i) for i in range(4))
            ua, ub = ua.to_pylist(), ub.to_pylist()
            for i in range(batch.num_rows):
                x, nx = bag(ua[i], ta[i].as_py())
                y, ny = bag(ub[i], tb[i].as_py())
                if min(nx, ny) < least_words or den * 2 * min(nx, ny) < num * (nx + ny):
                    continue
                both = nx if ua[i] == ub[i] else common_words_of(x, y)
                if den * 2 * both >= num * (nx + ny):
                    keep.append(i)
                    like.append(2 * both / (nx + ny))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(like, pa.float64())], ["a", "b", "likeness"])

    return run


def with_text(pairs: DataFrame, content: DataFrame, side: str, other: str, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``pairs`` with the text of ``side`` as t<side>. Contents with very many partners are dealt to several parts, their text to each."""
    hot = F.broadcast(cut_lineage(hot_contents(pairs, side, hot_pairs)))
    dealt = pairs.join(hot, F.col(side) == F.col("__hot"), "left").withColumn("part", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")).drop("__hot", "parts")
    texts = content.select(F.col("uid").alias(side), F.col("text").alias(f"t{side}")).join(hot, F.col(side) == F.col("__hot"), "left")
    texts = texts.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("__hot", "parts")
    return dealt.join(texts, [side, "part"]).drop("part")


def near_duplicate_contents(texts: DataFrame, least_words: int = 60, num: int = 4, den: int = 5) -> tuple[DataFrame, DataFrame]:
    """(links between contents, members of contents) of ``texts`` (kind, id, text).

    A content is a distinct lower-cased text within a kind. Links are (a, b, likeness), a < b for
    different contents and a = b for a content that several ids share; members are (uid, kind, id,
    proof). uid and proof are 64-bit hashes of the content, taken differently: ids are copies only if
    both agree.
    """
    rows = texts.where("kind is not null and id is not null and text is not null").select("kind", "id", "text")
    rows = rows.withColumn("uid", F.xxhash64("kind", F.lower("text")))
    members = rows.select("uid", "kind", "id", F.xxhash64(F.lower("text"), "kind").alias("proof")).distinct()
    common = common_words(rows)
    buckets = rows.select("uid", "text", "kind").mapInArrow(_buckets(common, least_words), "bucket bigint, uid bigint")
    partners = buckets.repartition("bucket").mapInArrow(_partners, "these array<bigint>, those array<bigint>")
    pairs = partners.select(F.explode("these").alias("a"), "those").select("a", F.explode("those").alias("b"))
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    shared = members.groupBy("uid").count().where("count > 1").select(F.col("uid").alias("a"), F.col("uid").alias("b"))
    pairs = cut_lineage(pairs)
    sketches = cut_lineage(rows.select("uid", "text", "kind").mapInArrow(_sketches(common, least_words), "uid bigint, rare binary, every binary").dropDuplicates(["uid"]))
    sketched = with_sketch(with_sketch(pairs, sketches, "a"), sketches, "b").select("a", "b", "ra", "ea", "rb", "eb")
    pairs = cut_lineage(sketched.mapInArrow(_likely, "a bigint, b bigint").unionByName(shared))
    ends = cut_lineage(pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid"))).distinct())
    few = ends.limit(BROADCAST_ENDS + 1).count() <= BROADCAST_ENDS
    content = rows.select("uid", "text").join(F.broadcast(ends) if few else ends, "uid", "left_semi").dropDuplicates(["uid"])
    full = with_text(with_text(pairs, content, "a", "b"), content, "b", "a").select("a", "b", "ta", "tb")
    return full.mapInArrow(_verified(least_words, num, den), "a bigint, b bigint, likeness double"), members


def near_duplicates(texts: DataFrame, least_words: int = 60, num: int = 4, den: int = 5) -> DataFrame:
    """(kind, left_id, right_id, likeness): all pairs of ids of one kind with a likeness of num/den or more.

    The likeness is twice the number of common words over the words of both, each as often as it
    occurs, in any order; words are runs of a-z and 0-9 in the lower-cased text. Texts with fewer than
    ``least_words`` words and null texts have no pairs; rows with the same kind and id count once;
    extra columns are ignored. Found by min-max hashing (see README for the measured recall), every
    pair checked exactly.
    """
    links, members = near_duplicate_contents(texts, least_words, num, den)
    left = members.select(F.col("uid").alias("a"), "kind", F.col("id").alias("x"), F.col("proof").alias("p"))
    right = members.select(F.col("uid").alias("b"), F.col("id").alias("y"), F.col("proof").alias("q"))
    pairs = links.join(left, "a").join(right, "b").where("(a <> b or (p = q and x < y)) and x <> y")
    return pairs.select("kind", F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id"), "likeness").distinct()


def near_duplicate_classes(texts: DataFrame, least_words: int = 60, num: int = 4, den: int = 5) -> DataFrame:
    """(kind, id, class_id, links) for every id: the smallest id it is joined to, directly or through others, and its number of direct links.

    Copies are joined to the content they share and never paired; an id without likeness is its own
    class with 0 links, as are texts that are null or too short. Nulls in kind or id are left out.
    """
    links, members = near_duplicate_contents(texts, least_words, num, den)
    links = cut_lineage(links)
    held = cut_lineage(members)
    size = held.groupBy("uid").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    copies = size.join(links.where("a = b").select(F.col("a").alias("uid")), "uid", "left_semi")
    ends = links.where("a <> b").select(F.col("a").alias("uid"), F.col("b").alias("other")).unionByName(links.where("a <> b").select(F.col("b").alias("uid"), F.col("a").alias("other")))
    number = ends.join(size.select(F.col("uid").alias("other"), "size"), "other").groupBy("uid").agg(F.sum("size").alias("n"))
    named = held.join(copies.select("uid", "first"), "uid").select("kind", F.col("id").alias("x"), F.col("first").alias("y"))
    lead = size.select("uid", "first")
    across = links.where("a <> b").join(lead.select(F.col("uid").alias("a"), F.col("first").alias("x")), "a").join(lead.select(F.col("uid").alias("b"), F.col("first").alias("y")), "b")
    kinds = held.groupBy("uid").agg(F.min("kind").alias("kind"))
    edges = across.join(kinds.withColumnRenamed("uid", "a"), "a").select("kind", "x", "y").unionByName(named)
    groups = connected_groups(edges, "kind", "x", "y").select(F.col("scope").alias("kind"), F.col("item_key").alias("id"), F.col("group_key").alias("class_id"))
    copied = copies.select("uid", (F.col("size") - 1).alias("own"))
    per = held.join(number, "uid", "left").join(copied, "uid", "left").select("kind", "id", (F.coalesce("n", F.lit(0)) + F.coalesce("own", F.lit(0))).alias("links"))
    every = texts.where("kind is not null and id is not null").select("kind", "id").distinct()
    per = per.groupBy("kind", "id").agg(F.sum("links").alias("links"))
    out = every.join(per, ["kind", "id"], "left").join(groups, ["kind", "id"], "left")
    return out.select("kind", "id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def corpus_texts(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sections and fixed chunks as (kind, id, text)."""
    fixed = chunks.where(F.col("strategy") == "fixed")
    return sections.select(F.lit("section").alias("kind"), "id", "text").unionByName(fixed.select(F.lit("chunk").alias("kind"), "id", "text"))
