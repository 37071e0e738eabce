"""Consolidating pairwise matches into groups: union-find in edge partitions, forests merged upward.

Every edge partition is reduced to a spanning forest (stars: node -> smallest node of its tree), so
what moves on is at most one row per node and partition, however many pairs there were. Forests are
then merged through ever fewer partitions while a merged partition stays under ``max_edges`` rows.
Any split of edges is right, so forests are merged as the partitions lie: nothing is shuffled by a
scope or node that many rows may share. Once a merged forest would exceed that bound, merging goes on in place: edges are dealt out in turn
by their larger and by their smaller end, reduced to forests again, until nothing changes. The
hubs among the smaller ends are few by definition and broadcast, so a node joined to a third of all rows fills no task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.runtime import cut_lineage

FOREST = "scope string, child string, root string"
#: Rows that one task holds; 2 million edges of short strings take about 500 MB.
MAX_EDGES = 2_000_000
#: Roots with more than this share of all rows, and HUB_ROWS rows, are hubs: at most 1 / HUB_SHARE of them, whatever the rows.
HUB_SHARE, HUB_ROWS = 1e-4, 1000


def forest_arrays(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Root (smallest number) of each of the nodes 0..n-1 under the edges left-right."""
    root = np.arange(n)
    a, b = left, right
    while len(a):
        ra, rb = root[a], root[b]
        live = ra != rb
        if not live.any():
            break
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def _reduce(table: pa.Table) -> pa.Table:
    """The star forest of the edges in ``table``; nodes are numbered in order of scope and key, so roots are smallest keys."""
    scope, child, root = (table[c].combine_chunks() for c in ("scope", "child", "root"))
    size = pc.cast(pc.binary_length(scope), pa.string())
    node = pa.concat_arrays([pc.binary_join_element_wise(size, scope, k, "\0") for k in (child, root)]).dictionary_encode()
    order = pc.sort_indices(node.dictionary).to_numpy()
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    codes = number[node.indices.to_numpy()]
    half = len(child)
    tree = forest_arrays(codes[:half], codes[half:], len(order))
    place = np.empty(len(order), np.int64)
    place[codes[::-1]] = np.arange(2 * half)[::-1]
    keep = np.flatnonzero(tree != np.arange(len(order)))
    keys = pa.concat_arrays([child, root])
    return pa.table({"scope": scope.take(pa.array(place[keep] % half)), "child": keys.take(pa.array(place[keep])), "root": keys.take(pa.array(place[tree[keep]]))})


def _forests(block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= block_rows:
                small = _reduce(pa.Table.from_batches(held))
                held, rows = small.to_batches(), small.num_rows
                if rows > block_rows // 2:  # a forest of its own size: pass it on, start anew
                    yield from held
                    held, rows = [], 0
        if held:
            yield from _reduce(pa.Table.from_batches(held)).to_batches()

    return run


def _local(edges: DataFrame, block_rows: int) -> DataFrame:
    return edges.mapInArrow(_forests(block_rows), FOREST)


def connected_groups(edges: DataFrame, scope: str, left: str, right: str, max_edges: int = MAX_EDGES, fan_in: int = 8) -> DataFrame:
    """One row (scope, item_key, group_key) for every key joined to at least one other key.

    ``edges`` holds pairs of keys that belong together within one scope; group_key is the smallest
    key, by code point, of all keys joined directly or through others. Pairs with a null scope or
    key and self pairs join nothing; repeated pairs and both orders count once; an empty table gives
    no rows; other columns, whatever their names, are ignored. ``max_edges`` bounds the rows that
    one task holds and ``fan_in`` the partitions merged into one; neither changes the result.
    """
    pairs = edges.select(F.col(scope).cast("string").alias("scope"), F.col(right).cast("string").alias("child"), F.col(left).cast("string").alias("root"))
    pairs = pairs.where("scope is not null and child is not null and root is not null and child <> root")
    forest = cut_lineage(_local(pairs, max_edges))
    parts, rows = max(1, forest.rdd.getNumPartitions()), forest.count()
    bound = max_edges // 2  # a task that puts out fewer rows has passed nothing on unmerged
    while parts > 1 and rows <= bound * max(1, parts // fan_in):
        parts = max(1, parts // fan_in)
        forest = cut_lineage(_local(forest.coalesce(parts), max_edges))
        if parts > 1:
            rows = forest.count()
    if parts > 1 or rows > bound:
        forest = _alternate(forest, max_edges)
    members = forest.select("scope", F.col("child").alias("item_key"), F.col("root").alias("group_key"))
    roots = forest.select("scope", F.col("root").alias("item_key"), F.col("root").alias("group_key")).distinct()
    return members.unionByName(roots)


def _signature(forest: DataFrame) -> tuple:
    row = forest.agg(F.count("*"), F.sum(F.xxhash64("scope", "child", "root").cast("decimal(20,0)"))).first()
    return tuple(row)


def _alternate(forest: DataFrame, max_edges: int, hub_rows: int = HUB_ROWS) -> DataFrame:
    """Forests too large for one partition: rounds by larger end, then by smaller end, until stable.

    A round by the larger end brings all roots of a node together and joins them; a round by the
    smaller end shortens chains: each root with a link upward is replaced by the end of that link. The
    links of hubs, at most 1 / HUB_SHARE, are broadcast to their children; other roots have few.
    """
    before = None
    while True:
        forest = cut_lineage(_local(forest.repartition("scope", "child"), max_edges))
        least = max(hub_rows, int(forest.count() * HUB_SHARE))
        up = forest.groupBy("scope", "child").agg(F.min("root").alias("up")).withColumnRenamed("child", "root")
        hung = cut_lineage(forest.groupBy("scope", "root").agg(F.count("*").alias("n")).where(F.col("n") > least))
        hubs = hung.join(up, ["scope", "root"], "left").select("scope", "root", F.lit(True).alias("hub"), F.col("up").alias("hub_up"))
        marked = forest.join(F.broadcast(hubs), ["scope", "root"], "left")
        far = marked.where("hub").select("scope", "child", F.coalesce("hub_up", "root").alias("root"))
        near = marked.where("hub is null").select("scope", "child", "root").join(up, ["scope", "root"], "left").select("scope", "child", F.coalesce("up", "root").alias("root"))
        forest = cut_lineage(far.unionByName(near).distinct())
        now = _signature(forest)
        if now == before:
            return forest
        before = now
