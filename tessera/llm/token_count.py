"""Token counts by rank-synchronous array merging.

Pre-tokens that a worker has not yet seen are laid end to end in one ragged array of
symbols. Each round finds the lowest rank among the adjacent pairs of every sequence and
merges, in all sequences at once, every occurrence of that sequence's lowest pair
(left to right where occurrences overlap); sequences without a mergeable pair leave the
array. What survives of a sequence is its number of tokens. A merged symbol's number is
its rank, so the rank of a pair is the number of its bytes' token.

Defined results: a null text has a null count, an empty text 0; repeated rows and null
ids are counted like any other row, equal texts alike; very long texts are counted to their end;
an empty table gives an empty result; other columns are not read, and where the id column is
called n_tokens the count's column has an underscore appended.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.bpe import PATTERN, RANKS, _small, read_ranks
from tessera.llm.common import free_names

NONE = np.int32(2**31 - 1)
#: Pre-tokens whose counts a worker remembers; beyond it starts afresh. Changes speed only.
REMEMBERED = 400_000


class Merger:
    """Pair ranks in an open-addressing table of arrays, and the merging rounds."""

    def __init__(self, path: str = RANKS) -> None:
        ranks = read_ranks(path)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.base = np.int64(max(ranks.values()) + 1)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.bits = max(8, int(np.ceil(np.log2(len(pairs)))) + 1)
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.values = np.full(self.mask + 1, NONE, np.int32)
        key, todo = left * self.base + right, np.arange(len(pairs))
        slot = self._slot(key)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = todo[self.keys[slot[todo]] == -1]
            self.keys[slot[free]] = key[free]  # of several for one place the last stays
            placed = free[self.keys[slot[free]] == key[free]]
            self.values[slot[placed]] = rank[placed]
            todo = todo[self.keys[slot[todo]] != key[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE where no token has its bytes."""
        key = left.astype(np.int64) * self.base + right
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], NONE)
        todo = np.flatnonzero((found != key) & (found != -1))
        for _ in range(self.probes):
            if len(todo) == 0:
                break
            slot[todo] = (slot[todo] + 1) & self.mask
            found = self.keys[slot[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out

    def counts(self, sequences: list[bytes]) -> np.ndarray:
        """The number of tokens of each byte string."""
        sizes = np.array([len(s) for s in sequences], np.int64)
        done = np.minimum(sizes, 1)
        live = np.flatnonzero(sizes > 1)
        if len(live) == 0:
            return done
        symbols = self.byte[np.frombuffer(b"".join(s for s in sequences if len(s) > 1), np.uint8)]
        sizes = sizes[live]
        starts = np.cumsum(sizes) - sizes
        # rank[i]: of symbols i and i + 1; none across sequences
        rank = np.append(self.rank(symbols[:-1], symbols[1:]), NONE)
        rank[starts + sizes - 1] = NONE
        while len(live):
            least = np.minimum.reduceat(rank, starts)
            over = least == NONE
            if over.any():
                done[live[over]] = sizes[over]
                stay = np.repeat(~over, sizes)
                symbols, rank = symbols[stay], rank[stay]
                live, sizes, least = live[~over], sizes[~over], least[~over]
                starts = np.cumsum(sizes) - sizes
                if len(live) == 0:
                    break
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            # neighbours in a run of equal symbols overlap: every second of a run merges
            run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            if len(run) < len(at):
                within = np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))
                at = at[within % 2 == 0]
            owner = np.searchsorted(starts, at, side="right") - 1
            symbols[at] = rank[at]
            gone = np.zeros(len(symbols), bool)
            gone[at + 1] = True
            # the removed symbol's link to its right neighbour becomes the merged one's
            last = at + 1 == (starts + sizes - 1)[owner]
            rank[at] = np.where(last, NONE, 0)
            sizes = sizes - np.bincount(owner, minlength=len(sizes))
            place = np.cumsum(~gone) - 1
            symbols, rank = symbols[~gone], rank[~gone]
            starts = np.cumsum(sizes) - sizes
            at = place[at]
            right = at[rank[at] == 0] if len(at) else at
            right = right[right + 1 < len(symbols)]
            rank[right] = self.rank(symbols[right], symbols[right + 1])
            head = np.zeros(len(symbols), bool)
            head[starts] = True
            left = at[~head[at]] - 1
            rank[left] = self.rank(symbols[left], symbols[left + 1])
        return done


@lru_cache(maxsize=2)
def _merger(path: str) -> Merger:
    return Merger(path)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """id and n_tokens of every row. Row-local; no shuffle."""
    schema = T.StructType([docs.schema[id_col], T.StructField(*free_names(id_col, "n_tokens"), T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, split, known = _merger(ranks), regex.compile(pattern), {}
        for batch in _small(batches, 1):
            rows = [None if t is None else split.findall(t) for t in batch.column(1).to_pylist()]
            if len(known) > REMEMBERED:
                known.clear()
            new = list({token for row in rows if row for token in row if token not in known})
            known.update(zip(new, merger.counts([t.encode() for t in new]).tolist(), strict=True))
            counts = [None if row is None else sum(map(known.__getitem__, row)) for row in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=schema.names)

    return docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
