"""Byte-pair encoding of a corpus by a pair occurrence index.

All new words of a batch are laid out in one array of symbols. An index maps every merge that is
possible somewhere to all its places; the active merges are applied in ascending rank, each to all
its places at once, and only the lists of the neighbouring pairs are touched. A long unbroken run
costs no more per byte than a short word.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The public pattern that splits text before merging, and where the vocabularies lie.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words remembered per Python worker; a bound on memory, not on the result.
REMEMBERED = 300_000


class PairEncoder:
    """Ids of words under a table of token bytes and ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        import regex

        self.split = regex.compile(PATTERN).findall
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.merged[left, right] = rank
        self.known: dict[str, tuple[int, ...]] = {}

    def learn(self, words: list[str]) -> None:
        """Encodes ``words`` together and remembers their ids."""
        symbol: list[int] = []
        starts: list[int] = []
        byte, merged = self.byte, self.merged
        for w in words:
            starts.append(len(symbol))
            symbol.extend([byte[b] for b in w.encode("utf-8", "surrogatepass")])
            symbol.append(-1)
        size = len(symbol)
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        places: dict[int, list[int]] = {}
        for i, pair in enumerate(zip(symbol, symbol[1:])):
            rank = merged.get(pair)
            if rank is not None:
                places.setdefault(rank, []).append(i)
        active = list(places)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            todo = places.pop(rank, None)
            if todo is None:
                continue
            todo.sort()
            for k, i in enumerate(todo):
                left = symbol[i]
                if left < 0 or (j := after[i]) >= size or merged.get((left, symbol[j])) != rank:
                    continue
                symbol[i] = rank
                symbol[j] = -2
                after[i] = nxt = after[j]
                lower = False
                if nxt < size:
                    before[nxt] = i
                    new = merged.get((rank, symbol[nxt]))
                    if new is not None:
                        if new not in places:
                            places[new] = []
                            heapq.heappush(active, new)
                        places[new].append(i)
                        lower = new < rank
                prev = before[i]
                if prev >= 0:
                    new = merged.get((symbol[prev], rank))
                    if new is not None:
                        if new not in places:
                            places[new] = []
                            heapq.heappush(active, new)
                        places[new].append(prev)
                        lower = lower or new < rank
                if lower and k + 1 < len(todo):  # a lower rank has become possible: it goes first
                    if rank not in places:
                        places[rank] = []
                        heapq.heappush(active, rank)
                    places[rank].extend(todo[k + 1 :])
                    break
        for w, at in zip(words, starts):
            ids = []
            while symbol[at] != -1:
                ids.append(symbol[at])
                at = after[at]
            self.known[w] = tuple(ids)

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of every text; the empty list for null and empty texts."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        words = [self.split(t) if t else [] for t in texts]
        fresh = [w for w in set(chain.from_iterable(words)) if w not in self.known]
        if fresh:
            self.learn(fresh)
        known = self.known
        return [list(chain.from_iterable([known[w] for w in ws])) for ws in words]


@lru_cache(maxsize=2)
def encoder(path: str) -> PairEncoder:
    with open(path, "rb") as f:
        return PairEncoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def _shipped(documents: DataFrame, path: str) -> str:
    """Sends the vocabulary (a few MB) along with the job, so that it need not lie on every machine; gives the name it has there."""
    documents.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


def _ids(name: str, count_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(SparkFiles.get(name))
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids = own.encode_batch(part.column(1).to_pylist())
                out = pa.array([len(x) for x in ids], pa.int64()) if count_only else pa.array(ids, pa.list_(pa.int32()))
                kept = [i for i in range(part.num_columns) if i != 1]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), out], [*(part.schema.names[i] for i in kept), "tokens" if count_only else "ids"])

    return run


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of each text, without special tokens; one row per input row, no shuffle.

    Null and empty texts both give the empty list. Strings that look like special tokens are
    ordinary text. Any characters and any length are encoded whole; ids always decode to the text.
    """
    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key), F.col(text)).mapInArrow(_ids(_shipped(documents, vocabulary), False), f"`{key}` {kind}, ids array<int>")


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carry..., tokens): the number of ids that :func:`encode` gives, 0 for null and empty texts; ``carry`` names columns passed through."""
    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in (key, *carry))
    return documents.select(F.col(key), F.col(text), *map(F.col, carry)).mapInArrow(_ids(_shipped(documents, vocabulary), True), f"{kinds}, tokens bigint")
