"""Most similar vectors for every vector: probed lists, scanned in column blocks with early abandonment.

Vectors are scaled to length 1 and turned by a fixed rotation, so that a block of columns is a fair
sample of the whole. A bounded sample fits the list centres; every row is indexed in its nearest list
and visits the next nearest. The number of lists grows with the rows; many lists are found by a tree
of two levels. Within a list, columns are taken in blocks; after each, the partial distance
is held against the distance that still counts, and a pair whose partial distance is larger than a
hypothesis test allows is abandoned. Only the survivors are computed to the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.runtime import cut_lineage

#: Rows a list should hold, rows sampled per list to fit its centre, the lists up to which all centres are looked at, and
#: the most lists of one space (bounds sample, about 130 MB, and broadcast, 17 MB; with more than 16.8 million rows, lists grow).
LIST_ROWS, SAMPLE_PER_LIST, FLAT_LISTS, MOST_LISTS = 256, 16, 2048, 65_536
#: Significance of the test: a partial distance over d columns counts as sqrt(dim / d) / (1 + EPSILON / sqrt(d)) of the whole.
EPSILON = 2.1
#: Standard deviations a neighbour may lie off in one given direction, if its offset is spread evenly over all directions.
SIGMAS = 2.0
#: Members of a list, and rows that visit it, that one task compares; longer lists are dealt to several.
BLOCK_ROWS, BLOCK_VISITORS = 2048, 32_768
#: Rows that a list must have in the sample before its size is estimated.
LEAST_SEEN = 4
#: Queries and rows that are compared at once, and the share of surviving pairs above which a block of columns is finished as one product.
QUERY_ROWS, BASE_ROWS, DENSE = 1024, 4096, 0.05
#: Vectors with more copies than are searched, up to which they are broadcast; parts each is dealt to beyond it.
BROADCAST_COPIED, COPY_SALTS = 10_000, 16


def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def matrix(column: pa.Array) -> np.ndarray:
    dim = len(column[0]) if len(column) else 0
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(values, np.float32).reshape(len(column), dim)


def unit_rows(x: np.ndarray) -> np.ndarray:
    wide = x.astype(np.float64)
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


def squared(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distance of every row to every centre."""
    return (x**2).sum(1)[:, None] + (centre**2).sum(1)[None, :] - 2 * (x @ centre.T)


def fit_centres(sample: np.ndarray, number: int, rounds: int = 6) -> np.ndarray:
    """Unit centres by a few rounds of spherical k-means from rows of the sample, so dense regions get more of them."""
    sample = np.unique(sample, axis=0)
    rng = np.random.default_rng(7)
    centre = sample[rng.permutation(len(sample))[: max(1, min(number, len(sample)))]].copy()
    for _ in range(rounds if len(centre) < len(sample) else 0):
        own = np.concatenate([(sample[i : i + 8192] @ centre.T).argmax(1) for i in range(0, len(sample), 8192)])
        total = np.zeros_like(centre)
        np.add.at(total, own, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(norm > 1e-6, total / np.maximum(norm, 1e-6), centre).astype(np.float32)
    return centre


class Lists:
    """The lists of one space: their centres, below a level of few centres if they are many, and how many blocks a list is dealt to."""

    def __init__(self, sample: np.ndarray, lists: int, flat: int, probes: int, rows: int):
        if lists <= flat:
            self.top, self.start, self.centre = None, None, fit_centres(sample, lists)
        else:
            self.top = fit_centres(sample, int(np.ceil(np.sqrt(lists))))
            own = np.concatenate([(sample[i : i + 8192] @ self.top.T).argmax(1) for i in range(0, len(sample), 8192)])
            below = [fit_centres(sample[own == c], round((own == c).sum() / len(sample) * lists)) for c in range(len(self.top)) if (own == c).any()]
            self.top = self.top[np.unique(own)]
            self.start = np.concatenate([[0], np.cumsum([len(x) for x in below])])
            self.centre = np.concatenate(below)
        near = np.concatenate([self.near(sample[i : i + 4096], probes)[0] for i in range(0, len(sample), 4096)])
        scale = rows / len(sample)
        own, seen = np.unique(near[:, 0], return_counts=True)
        met, times = np.unique(near, return_counts=True)
        blocks = np.ceil(seen * scale / BLOCK_ROWS)
        visits = np.ceil(times[np.searchsorted(met, own)] * scale / BLOCK_VISITORS)
        large = (seen >= min(LEAST_SEEN, len(sample))) & ((blocks > 1) | (visits > 1))
        self.long, self.members, self.visitors = own[large], blocks[large].astype(np.int64), visits[large].astype(np.int64)

    def _closest(self, close: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
        m = min(number, close.shape[1])
        at = np.argpartition(-close, m - 1, axis=1)[:, :m]
        at = np.take_along_axis(at, np.argsort(-np.take_along_axis(close, at, 1), axis=1, kind="stable"), 1)
        return at, np.take_along_axis(close, at, 1)

    def near(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """(lists, offs): the nearest lists of each row in order, and the distance of the row to the plane between the first and each."""
        if self.top is None:
            at, close = self._closest(x @ self.centre.T, probes)
        else:  # the lists below the nearest centres of the upper level
            upper, _ = self._closest(x @ self.top.T, 2 * probes)
            widest = int(np.diff(self.start).max())
            close = np.full((len(x), upper.shape[1], widest), -np.inf, np.float32)
            for c in np.unique(upper):
                row, place = np.nonzero(upper == c)
                close[row, place, : self.start[c + 1] - self.start[c]] = x[row] @ self.centre[self.start[c] : self.start[c + 1]].T
            at, close = self._closest(close.reshape(len(x), -1), probes)
            at = self.start[np.take_along_axis(upper, at // widest, 1)] + at % widest
            at = np.where(np.isfinite(close), at, at[:, :1])
        gap = np.linalg.norm(self.centre[at[:, :1]] - self.centre[at], axis=2)
        return at, np.where(gap > 0, (close[:, :1] - close) / np.maximum(gap, 1e-9), np.inf)

    def dealt(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blocks of members and of visitors of each list."""
        if not len(self.long):
            return np.ones(len(lists), np.int64), np.ones(len(lists), np.int64)
        at = np.minimum(np.searchsorted(self.long, lists), len(self.long) - 1)
        hit = self.long[at] == lists
        return np.where(hit, self.members[at], 1), np.where(hit, self.visitors[at], 1)


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(space, id, vec): turned directions, as whole numbers of 16 bits per column (cosines keep about five digits)."""
    for batch in batches:
        dims: dict[int, list[int]] = {}
        column = batch.column(2)
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        for i, n in enumerate(sizes):
            dims.setdefault(int(n), []).append(i)
        for dim, at in dims.items():
            if not dim:
                continue
            part = batch.take(pa.array(at, pa.int64()))
            x = matrix(part.column(2))
            x = np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)
            good = np.flatnonzero((x != 0).any(1))
            if len(good):
                turned = (unit_rows(x[good]) @ rotation(dim)).astype(np.float32)
                packed = np.rint(turned / np.abs(turned).max(1, keepdims=True) * 32767).astype(np.int16)
                keep = part.take(pa.array(good))
                yield pa.RecordBatch.from_arrays([keep.column(0), keep.column(1), pa.array([r.tobytes() for r in packed], pa.binary())], ["space", "id", "vec"])


def unpack(rows: list[bytes]) -> np.ndarray:
    """Unit vectors out of packed directions of one width."""
    return unit_rows(np.frombuffer(b"".join(rows), np.int16).reshape(len(rows), len(rows[0]) // 2))


def _probe(lists: dict[str, Lists], probes: int, least: float):
    """Each row goes to its own list (own = true) and to the next nearest; long lists are dealt to blocks of members by blocks of visitors.

    A neighbour of cosine ``least`` that belongs to another list lies beyond the plane halfway between
    the two centres. A list is not visited if that plane is further off than the neighbour's offset
    reaches in one direction.
    """
    reach = np.sqrt(max(0.0, 2 - 2 * least)) * SIGMAS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                spaces = np.array(part.column(0).to_pylist(), dtype=object)
                hashes = part.column(3).to_numpy()
                for space in set(spaces.tolist()):
                    where = np.flatnonzero(spaces == space)
                    rows = part.take(pa.array(where))
                    x = unpack(rows.column(2).to_pylist())
                    near, off = lists[space].near(x, probes)
                    row, own_list, block, own = [], [], [], []
                    for j in range(near.shape[1]):
                        members, visitors = lists[space].dealt(near[:, j])
                        go = off[:, j] <= (reach / np.sqrt(x.shape[1]) if least > 0.5 else 1e9) if j else np.ones(len(x), bool)
                        mine = hashes[where] % members if j == 0 else np.full(len(where), -1)
                        turn = hashes[where] // 64 % visitors
                        for b in range(int(members[go].max(initial=0))):
                            for v in range(int(visitors[go].max(initial=0))):
                                hit = np.flatnonzero(go & (members > b) & (visitors > v) & ((mine == b) | (turn == v)))
                                row.append(hit)
                                own_list.append(near[hit, j])
                                block.append(b * visitors[hit] + v)
                                own.append(mine[hit] == b)
                    row = np.concatenate(row)
                    picked = rows.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [picked.column(0), pa.array(np.concatenate(own_list).astype(np.int64)), pa.array(np.concatenate(block).astype(np.int32)), picked.column(1), pa.array(np.concatenate(own)), picked.column(2)],
                        ["space", "list", "block", "id", "own", "vec"],
                    )

    return run


def best_of(i: np.ndarray, j: np.ndarray, cosine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k pairs of largest cosine (to six digits) per i; ties go to the smaller j."""
    order = np.lexsort((j, -np.round(cosine, 6), i))
    i, j, cosine = i[order], j[order], cosine[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[kept], j[kept], cosine[kept]


def abandoning(q: np.ndarray, base: np.ndarray, bound: np.ndarray, skip: np.ndarray, k: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine) of the pairs that outlive the test after every block of columns; blocks double in width from ``first``.

    ``bound`` is, per query, the squared distance that still counts; it is lowered here by a few
    likely pairs if it is that of any pair.
    """
    dim = q.shape[1]
    edges = [0]
    while edges[-1] < dim:
        edges.append(min(dim, max(first, 2 * edges[-1])))
    limit = lambda d: (bound * (d / dim * (1 + EPSILON / np.sqrt(d)) ** 2 if d < dim else 1.0) + 1e-5).astype(np.float32)
    a, b = q[:, :first], base[:, :first]
    part = a @ b.T
    near = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * part
    has = np.flatnonzero(skip >= 0)
    near[has, skip[has]] = np.inf
    if len(base) > 4 * k and bound.max() >= 2:
        guess = np.argpartition(near, 2 * k, axis=1)[:, : 2 * k]
        done = 2 - 2 * np.einsum("ij,ikj->ik", q, base[guess])
        done[~np.isfinite(np.take_along_axis(near, guess, 1))] = np.inf
        bound = np.minimum(bound, np.partition(done, k - 1, axis=1)[:, k - 1])
    live = near <= limit(first)[:, None]
    step = 1
    while edges[step] < dim and np.count_nonzero(live) > live.size * DENSE:  # many pairs: the next columns as one product
        a, b = q[:, edges[step] : edges[step + 1]], base[:, edges[step] : edges[step + 1]]
        step += 1
        more = a @ b.T
        part += more
        near += (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * more
        live &= near <= limit(edges[step])[:, None]
    if edges[step] == dim and len(base) > k:  # whole cosines: what ties with the k-th best stays
        kth = np.partition(np.where(live, part, -np.inf), len(base) - k, axis=1)[:, len(base) - k]
        live &= part >= kth[:, None] - 2e-6
    i, j = np.nonzero(live)
    cosine, dist = part[i, j], near[i, j]
    while edges[step] < dim:
        a, b = q[i, edges[step] : edges[step + 1]], base[j, edges[step] : edges[step + 1]]
        step += 1
        more = np.einsum("ij,ij->i", a, b)
        cosine, dist = cosine + more, dist + (a**2).sum(1) + (b**2).sum(1) - 2 * more
        keep = np.flatnonzero(dist <= limit(edges[step])[i])
        i, j, cosine, dist = i[keep], j[keep], cosine[keep], dist[keep]
    return i, j, cosine


def scan(queries: np.ndarray, base: np.ndarray, k: int, least: float, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query rows, base rows, cosines): for each query its k best base rows of cosine ``least`` or more.

    ``skip[i]`` is the base row that is query i itself, or -1; base rows are in order of their ids, so
    that ties go to the smaller one. Queries and base rows are taken in blocks, so memory does not
    grow with the list; the bound of a query is its k-th best distance in the blocks before, or ``least``.
    """
    dim = queries.shape[1]
    first = min(dim, 16 if least > 0.5 else 32)
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))]
    for at in range(0, len(queries), QUERY_ROWS):
        q, own = queries[at : at + QUERY_ROWS], skip[at : at + QUERY_ROWS]
        bound = np.full(len(q), min(4.0, 2 - 2 * least))
        i, j, c = out[0]
        for start in range(0, len(base), BASE_ROWS):
            part = base[start : start + BASE_ROWS]
            inside = np.where((own >= start) & (own < start + len(part)), own - start, -1)
            ni, nj, nc = abandoning(q, part, bound, inside, k, first)
            good = np.flatnonzero(nc >= least - 1e-6)
            i, j, c = best_of(np.concatenate([i, ni[good]]), np.concatenate([j, nj[good] + start]), np.concatenate([c, nc[good]]), k)
            last = np.flatnonzero(np.bincount(i, minlength=len(q)) == k)
            if len(last):
                end = np.searchsorted(i, last, side="right") - 1
                bound[last] = np.minimum(bound[last], 2 - 2 * c[end] + 2e-6)
        out.append((i + at, j, c))
    return tuple(np.concatenate(x) for x in zip(*out))


def _search(k: int, least: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids = table["id"].combine_chunks()
        own = table["own"].to_numpy()
        x = unpack(table["vec"].to_pylist())
        members, visitors = np.flatnonzero(own), np.flatnonzero(~own)
        found = []
        if len(members):
            place = np.full(len(x), -1)
            place[members] = np.arange(len(members))
            i, j, c = scan(x, x[members], k, least, place)
            found.append((i, members[j], c))
            if len(visitors):  # members also look at the rows that visit their list
                i, j, c = scan(x[members], x[visitors], k, least, np.full(len(members), -1))
                found.append((members[i], visitors[j], c))
        i, j, c = (np.concatenate(a) for a in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        space = table["space"].combine_chunks().take(pa.array(i, pa.int64()))
        return pa.table({"space": space, "id": ids.take(pa.array(i, pa.int64())), "other": ids.take(pa.array(j, pa.int64())), "cosine": pa.array(np.round(np.asarray(c, np.float64), 6))})

    return run


def nearest(vectors: DataFrame, k: int = 5, least: float = -1.0, probes: int = 12, list_rows: int = LIST_ROWS, most_lists: int = MOST_LISTS, flat_lists: int = FLAT_LISTS, copies: bool = True) -> DataFrame:
    """(space, id, other, cosine, rank): up to k most similar other ids of the same space for every id.

    ``vectors`` has (space, id, vector). Null, all-zero and empty vectors and null ids are left out,
    not finite entries count 0, rows with the same space and id count once (one of them, where the
    vectors differ). Ties (cosines equal to six digits) go to the smaller id. Of identical vectors
    only the k + 1 smallest ids are searched: a further copy is nobody's neighbour, and its own
    neighbours are those of the last one searched, which it gets unless ``copies`` is false. ``least`` leaves out smaller cosines. There
    is a list for every ``list_rows`` rows, ``most_lists`` at most; their centres are fitted to a sample of at most
    ``SAMPLE_PER_LIST * most_lists`` rows per space; every row is indexed. See README for the recall measured against brute force.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("space").cast("string"), F.col("id").cast("string"), "vector").where("space is not null and id is not null and vector is not null")
    ready = rows.mapInArrow(_usable, "space string, id string, vec binary").withColumn("h", F.abs(F.xxhash64("space", "vec") % 1000000007))
    same = Window.partitionBy("space", "h", "vec").orderBy("id")
    first = ready.withColumn("r", F.dense_rank().over(same)).where(F.col("r") <= k + 1).dropDuplicates(["space", "h", "vec", "id"])
    once = first.drop("r")
    counts = {r[0]: r[1] for r in rows.groupBy("space").count().collect()}
    if not counts:
        return spark.createDataFrame([], "space string, id string, other string, cosine double, rank int")
    lists = {s: min(most_lists, max(1, round(n / list_rows))) for s, n in counts.items()}
    share = F.create_map(*[x for s in counts for x in (F.lit(s), F.lit(min(1.0, lists[s] * SAMPLE_PER_LIST / counts[s])))])
    drawn = ready.where(F.pmod(F.xxhash64("id"), F.lit(1000003)) < share[F.col("space")] * 1000003).select("space", "vec")
    sample: dict[str, list[bytes]] = {}
    for r in drawn.toLocalIterator():
        sample.setdefault(r[0], []).append(bytes(r[1]))
    fitted = {}
    for s, n in counts.items():
        own = sample.get(s) or [bytes(r[0]) for r in ready.where(F.col("space") == s).select("vec").limit(1).collect()]
        if own:
            width = max(map(len, own))
            fitted[s] = Lists(unpack([v for v in own if len(v) == width]), lists[s], flat_lists, probes, n)
    sent = once.select("space", "id", "vec", "h").mapInArrow(_probe(fitted, probes, least), "space string, list bigint, block int, id string, own boolean, vec binary")
    found = sent.groupBy("space", "list", "block").applyInArrow(_search(k, least), "space string, id string, other string, cosine double")
    best = found.groupBy("space", "id", "other").agg(F.max("cosine").alias("cosine"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("space", "id").orderBy(F.desc("cosine"), "other")))
    ranked = ranked.where(F.col("rank") <= k)
    return _with_copies(ranked, ready, first.where(F.col("r") == k + 1)) if copies else ranked


def _with_copies(ranked: DataFrame, ready: DataFrame, last: DataFrame) -> DataFrame:
    """``ranked`` with the ids that were not searched; each has the neighbours of ``last``, the largest searched id of its vector."""
    ranked = cut_lineage(ranked)
    near = last.select("space", "h", "vec", F.col("id").alias("searched")).join(ranked.withColumnRenamed("id", "searched"), ["space", "searched"])
    near = cut_lineage(near.groupBy("space", "h", "vec", "searched").agg(F.collect_list(F.struct("other", "cosine", "rank")).alias("near")))
    found = near.limit(BROADCAST_COPIED + 1).count()
    if not found:
        return ranked
    if found <= BROADCAST_COPIED:
        more = ready.join(F.broadcast(near), ["space", "h", "vec"])
    else:
        dealt = ready.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(COPY_SALTS)).cast("int"))
        more = dealt.join(near.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(COPY_SALTS - 1)))), ["space", "h", "vec", "salt"])
    more = more.where(F.col("id") > F.col("searched")).select("space", "id", "near").dropDuplicates(["space", "id"])
    more = more.join(ranked.where(F.col("rank") == 1).select("space", "id"), ["space", "id"], "left_anti")
    return ranked.unionByName(more.select("space", "id", F.inline("near")))


def mutual_pairs(vectors: DataFrame, k: int = 5, least: float = 0.9, probes: int = 12) -> DataFrame:
    """(space, left_id, right_id): pairs where each is among the k most similar of the other and the cosine is ``least`` or more.

    Leaving out smaller cosines changes no rank of a pair that is kept, and further copies are nobody's neighbours. Ties, copies, nulls and
    repeated rows as in :func:`nearest`.
    """
    near = nearest(vectors, k, least, probes, copies=False).select("space", F.least("id", "other").alias("left_id"), F.greatest("id", "other").alias("right_id"))
    return near.groupBy("space", "left_id", "right_id").agg(F.count("*").alias("n")).where("n = 2").drop("n")


def archive_vectors(vectors: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunk vectors (all collections together) and cached embeddings (by model) as (space, id, vector)."""
    chunk = vectors.select(F.lit("vectors").alias("space"), F.col("chunk_id").alias("id"), "vector")
    return chunk.unionByName(cache.select(F.concat(F.lit("cache:"), "model_id").alias("space"), F.col("hash").alias("id"), "vector"))
