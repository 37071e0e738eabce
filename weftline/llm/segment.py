"""Splitting long texts at natural boundaries by lexical cohesion, and auditing stored cuts.

A text is described once by its boundary map: which positions are natural, which lie inside a word,
and how deep the valley of word similarity is at each natural position. The splitter takes, within
each size window, the natural position with the deepest valley and starts the next piece with an
overlap before it; the auditor holds given pieces against the same map.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, LEAST, OVERLAP = 1600, 800, (80, 320)
#: Words on either side of a position whose vocabularies are compared.
BLOCK = 32
#: Positions whose blocks are compared at once; a bound on memory, not on the text.
PLACES = 1024
WORD = re.compile(r"\w+")


class Boundaries:
    """The boundary map of one text; positions run from 0 to its length in code points."""

    def __init__(self, text: str, limit: int = LIMIT):
        self.text = text
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        n = self.n = len(chars)
        lf = chars == 10
        self.blank = blank = (chars == 32) | (chars == 9) | (chars == 13) | lf
        edge = np.ones(1, bool)
        blank_before, blank_after = np.concatenate([~edge, blank]), np.concatenate([blank, ~edge])
        by_lf = np.concatenate([~edge, lf]) | np.concatenate([lf, ~edge])
        solid = np.where(blank, -1, np.arange(n))
        last = np.concatenate([[-1], np.maximum.accumulate(solid)]) if n else np.array([-1])
        stop = (chars == 46) | (chars == 33) | (chars == 63)
        ended = np.where(last >= 0, np.concatenate([stop, ~edge])[last], False)
        self.natural = by_lf | ((blank_before | blank_after) & ended)
        self.natural[0] = self.natural[n] = True
        inside = np.zeros(n + 1, bool)
        inside[1:n] = ~blank[: n - 1] & ~blank[1:] if n > 1 else False
        change = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
        for a, b in zip(change[::2], change[1::2]):
            if b - a > limit:
                inside[a + 1 : b] = False
        self.inside = inside

    def valleys(self, block: int = BLOCK) -> dict[int, float]:
        """Depth of the similarity valley at each natural position inside the text."""
        at = np.flatnonzero(self.natural)
        at = at[(at > 0) & (at < self.n)]
        spans = [(m.start(), m.group().lower()) for m in WORD.finditer(self.text)]
        if not len(at) or not spans:
            return {int(p): 0.0 for p in at}
        number: dict[str, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for _, w in spans), np.int64, len(spans))
        starts = np.fromiter((s for s, _ in spans), np.int64, len(spans))
        padded = np.concatenate([np.full(block, -1), ids, np.full(block, -2)])
        gap = np.searchsorted(starts, at)
        same = lambda a, b: (a[:, :, None] == b[:, None, :]).sum((1, 2)).astype(float)
        cosine = np.empty(len(at))
        for i in range(0, len(at), PLACES):
            take = gap[i : i + PLACES, None] + np.arange(block)
            left, right = padded[take], padded[take + block]
            cosine[i : i + PLACES] = same(left, right) / np.sqrt(np.maximum(1, same(left, left) * same(right, right)))
        up_left = np.maximum.accumulate(cosine)
        up_right = np.maximum.accumulate(cosine[::-1])[::-1]
        depth = (up_left - cosine) + (up_right - cosine)
        return dict(zip(at.tolist(), depth.tolist()))


def split(text: str | None, limit: int = LIMIT, least: int = LEAST, overlap: tuple[int, int] = OVERLAP) -> list[tuple[int, int]]:
    """Pieces (start, end) of one text; see :func:`split_texts`."""
    if text is None or not text.strip(" \t\r\n"):
        return []
    if len(text) <= limit:
        return [(0, len(text))]
    b = Boundaries(text, limit)
    depth = b.valleys()
    n, free = b.n, ~b.inside
    middle = sum(overlap) // 2

    def steps(s: int):
        window = slice(s + 1, min(s + limit, n - 1) + 1)
        nat = np.flatnonzero(b.natural[window]) + s + 1
        good = [p for p in nat.tolist() if p >= s + least]
        if good:
            ends = sorted(good, key=lambda p: (-depth[p], -p)) + [p for p in reversed(nat.tolist()) if s + overlap[0] < p < s + least]
        else:
            ends = [p for p in (np.flatnonzero(free[window]) + s + 1)[::-1].tolist() if p > s + overlap[0]]
        for e in ends:
            low = max(s + 1, e - overlap[1])
            starts = np.flatnonzero(free[low : e - overlap[0] + 1]) + low
            if len(starts):
                first = starts[b.natural[starts]]
                pool = first if len(first) else starts
                yield e, int(pool[np.argmin(np.abs(pool - (e - middle)))])
                if len(first) and len(starts) > len(first):
                    yield e, int(starts[-1])

    path: list[tuple[int, int]] = []
    trail = [(0, steps(0))]
    dead: set[int] = set()
    while trail:
        s, options = trail[-1]
        if n - s <= limit:
            return [*path, (s, n)]
        for e, nxt in options:
            if nxt not in dead:
                path.append((s, e))
                trail.append((nxt, steps(nxt)))
                break
        else:
            dead.add(s)
            trail.pop()
            if path:
                path.pop()
    # No proper cut exists (an unbroken run almost as long as the limit): cut inside the run.
    out, s = [], 0
    while n - s > limit:
        out.append((s, s + limit))
        s += limit - middle
    return [*out, (s, n)]


def proper(text: str, pieces: list[tuple[int, int]], limit: int = LIMIT, least: int = LEAST, overlap: tuple[int, int] = OVERLAP) -> bool:
    """Whether ``pieces`` (ordered by start, relative to the text) are a proper cut of the text."""
    if not pieces:
        return False
    b = Boundaries(text, limit)
    n, reach = b.n, 0
    if any(s < 0 or e > n or e - s > limit or s > e for s, e in pieces):
        return False
    for k, (s, e) in enumerate(pieces):
        if b.inside[s]:
            return False
        if k and not overlap[0] <= pieces[k - 1][1] - s <= overlap[1]:
            return False
        if s > reach and not b.blank[reach:s].all():
            return False
        reach = max(reach, e)
        if k < len(pieces) - 1 and not b.natural[e]:
            if b.natural[s + least : min(s + limit, n - 1) + 1].any() or b.inside[e]:
                return False
    return bool(b.blank[reach:].all())


PIECES = T.ArrayType(T.StructType([T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType())]))


@F.pandas_udf(PIECES)
def _split(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"start_char": s, "end_char": e} for s, e in split(t)])


@F.pandas_udf(T.BooleanType())
def _faulty(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    return pd.Series([not proper(t, list(zip(s.tolist(), e.tolist())) if s is not None else []) for t, s, e in zip(texts, starts, ends)], dtype=bool)


def split_texts(sections: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, start_char, end_char, strategy) for every piece of every text; no shuffle but the distinct.

    No piece is longer than 1,600 code points; pieces end at natural places, at the deepest valley
    of lexical cohesion among those 800 to 1,600 after the start, and overlap by 80 to 320. A text
    within the limit is one piece; a null, empty or blank text has none. Where an unbroken run
    leaves no such cut, pieces of the limit are cut inside it. Repeated rows count once.
    """
    pieces = sections.select(F.col(key), F.col(text).alias("__text")).withColumn("__p", F.explode(_split("__text")))
    return pieces.select(key, "__p.start_char", "__p.end_char", F.lit("recursive").alias("strategy")).distinct()


def audited(sections: DataFrame, chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(section_id, text, faulty) for the sections longer than the limit.

    ``faulty`` says that the stored recursive chunks are no proper cut of the text (none stored,
    too long, a character left out, overlap outside 80 to 320, a start inside a word, an end at no
    natural place though one was in reach). Stored
    positions count from the section's start_char. Null texts are left out; chunks without a section
    and stored cuts with a null position are ignored; repeated rows count once.
    """
    long = sections.where(F.length("text") > limit).select("id", F.col("start_char").alias("__from"), "text")
    stored = chunks.where((F.col("strategy") == "recursive") & F.col("start_char").isNotNull() & F.col("end_char").isNotNull()).select(F.col("section_id").alias("id"), F.struct(F.col("start_char").alias("s"), F.col("end_char").alias("e")).alias("__c"))
    cuts = stored.groupBy("id").agg(F.array_sort(F.collect_set("__c")).alias("__cuts"))
    both = long.dropDuplicates(["id"]).join(cuts, "id", "left")
    at = lambda f: F.transform("__cuts", lambda c: (c[f] - F.col("__from")).cast("int"))
    return both.select(F.col("id").alias("section_id"), "text", _faulty("text", at("s"), at("e")).alias("faulty"))


def recut(sections: DataFrame, chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(section_id, faulty, pieces) as :func:`audited` says; ``pieces`` is the new cut of a faulty one, else empty."""
    none = F.array().cast("array<struct<start_char:int,end_char:int>>")
    return audited(sections, chunks, limit).select("section_id", "faulty", F.when(F.col("faulty"), _split(F.when(F.col("faulty"), F.col("text")))).otherwise(none).alias("pieces"))
