"""Repetition inside one document: rolling hashes of several n-gram lengths, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
LENGTHS = (5, 10)
BASE = np.uint64(0x9E3779B97F4A7C15)
RESULT = "words int, repeated_words int, " + ", ".join(f"char_share_{n} double" for n in LENGTHS) + ", line_share double"


def rolling(codes: np.ndarray, n: int) -> np.ndarray:
    """The polynomial hash of every window of n codes, modulo 2^64."""
    if len(codes) < n:
        return np.empty(0, np.uint64)
    h = np.zeros(len(codes) - n + 1, np.uint64)
    for k in range(n):
        h = h * BASE + codes[k : len(codes) - n + 1 + k]
    return h


def later(values: np.ndarray) -> np.ndarray:
    """Whether each value also stands at an earlier place."""
    _, first, inverse = np.unique(values, return_index=True, return_inverse=True)
    return first[inverse] != np.arange(len(values))


def covered(flags: np.ndarray, n: int, size: int) -> np.ndarray:
    """Places 0..size-1 that lie in a flagged window of n places."""
    step = np.zeros(size + 1, np.int64)
    at = np.flatnonzero(flags)
    np.add.at(step, at, 1)
    np.add.at(step, at + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure(text: str | None, codes: dict[str, int]) -> tuple:
    """(words, repeated words, share of characters in repeated n-grams per length, in repeated lines) of one text."""
    if not text:
        return (0, 0, *[0.0] * len(LENGTHS), 0.0)
    low = text.lower()
    spans = [m.span() for m in WORD.finditer(low)]
    size = len(spans)
    words = [low[a:b] for a, b in spans]
    local = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.uint64, size)
    mixed = (local + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    out: list = []
    repeated = 0
    length = np.fromiter((b - a for a, b in spans), np.int64, size)
    for n in LENGTHS:
        mark = covered(later(rolling(mixed, n)), n, size) if size >= n else np.zeros(size, bool)
        if n == LENGTHS[0]:
            repeated = int(mark.sum())
        out.append(round(float(length[mark].sum()) / max(1, int(length.sum())), 6))
    lines = [x.strip() for x in low.split("\n")]
    lines = [x for x in lines if x]
    seen: set[str] = set()
    again = total = 0
    for x in lines:
        total += len(x)
        again += len(x) if x in seen else 0
        seen.add(x)
    return (size, repeated, *out, round(again / max(1, total), 6))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        codes: dict[str, int] = {}
        for t in batch.column(1).to_pylist():
            if len(codes) > 500_000:
                codes = {}
            rows.append(measure(t, codes))
        cols = list(zip(*rows)) if rows else [[]] * (3 + len(LENGTHS))
        kinds = [pa.int32(), pa.int32(), *[pa.float64()] * len(LENGTHS), pa.float64()]
        names = [x.split()[0] for x in RESULT.split(", ")]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], [batch.schema.names[0], *names])


def repetition_scores(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shares of repeated content of each document: one row per input row, no shuffle.

    Words are maximal runs of letters and digits in the lower-cased text; a word is repeated if it
    lies in a run of five words that also begins at an earlier word. ``char_share_n`` is the share
    of word characters inside n-grams seen earlier, ``line_share`` that of characters in lines seen
    earlier. Null and empty texts and texts without words count 0 everywhere; a null key is kept;
    repeated rows come out as often as they came in; whole texts are measured, of any length.
    """
    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key), F.col(text)).mapInArrow(_run, f"`{key}` {kind}, {RESULT}")


def repetitive(documents: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = 20, tenths: int = 3) -> DataFrame:
    """The keys of documents with at least ``least_words`` words of which ``tenths`` tenths are repeated."""
    scored = repetition_scores(documents, key, text)
    return scored.where((F.col("words") >= least_words) & (F.col("repeated_words") * 10 >= F.col("words") * tenths)).select(key).distinct()
