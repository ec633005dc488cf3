"""Sharding by histogram sort.

Rows are ordered by a key and cut into shards of equal bytes. The narrow pairs (key,
bytes) are kept apart from the texts. Each round puts probes evenly into every interval
that still holds an unsettled splitter and counts, in one pass over the pairs, the exact
bytes at or below each probe; partial sums of a partition are all that moves. A splitter
is settled when a probe's count is within the tolerance of its target, or when its
interval is a single key: then it is the smallest key at which the target is reached.
The rows are exchanged once, after the last round, straight into their shard's partition.

Keys are whole numbers (a null key sorts below all). Rows of equal keys stay together, so
a shard can pass its target by its last key's bytes, and hot keys can leave shards empty.

Defined results: a null or empty text weighs 0 bytes, a very long one all of its own, in one shard; with all texts empty everything is
in shard 0; repeated rows are all kept; an empty table gives an empty result; other
columns are carried along, and one called like the shard column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialise

#: The null key's place, below every other key.
LOWEST = -(2**63)
#: Probes in a round at most, so far as there are fewer unsettled splitters; changes the number of rounds only.
MOST_PROBES = 1 << 20


def splitters(pairs: DataFrame, shards: int, tolerance: float = 0.0, probes: int = 15) -> np.ndarray:
    """``shards`` - 1 ascending keys; shard i holds the keys above splitter i - 1 up to splitter i.

    ``pairs`` has key (long, not null) and bytes (long). ``tolerance`` is a share of a shard's target.
    """
    low, high, total = pairs.agg(F.min("key"), F.max("key"), F.sum("bytes")).first()
    if low is None or shards < 2:
        return np.zeros(0, np.int64)
    targets = np.array([-(-total * i // shards) for i in range(1, shards)], np.int64)
    slack = int(tolerance * total / shards)
    # for each splitter: keys (a, b] hold it; b is known to reach the target
    a, b = np.full(len(targets), low - 1, np.int64), np.full(len(targets), high, np.int64)
    while True:
        apart = b.view(np.uint64) - a.view(np.uint64)
        live = np.flatnonzero(apart > 1)
        if len(live) == 0:
            return b
        # splitters of one interval share its probes; targets ascend, and so do intervals
        own = live[np.append(True, (a[live][1:] != a[live][:-1]) | (b[live][1:] != b[live][:-1]))]
        probe = _points(a[own], apart[own], max(1, min(probes, MOST_PROBES // len(own))))
        below = _bytes_at_or_below(pairs, probe)
        at = np.searchsorted(below, targets[live], side="left")
        before, here = np.maximum(at - 1, 0), np.minimum(at, len(probe) - 1)
        a[live] = np.where(at > 0, np.maximum(a[live], probe[before]), a[live])
        b[live] = np.where(at < len(probe), np.minimum(b[live], probe[here]), b[live])
        if slack:
            off = np.abs(below[np.stack([before, here])] - targets[live]) + np.where(below[np.stack([before, here])] > 0, 0, total + 1)
            near = np.where(off[0] <= off[1], before, here)
            done = off.min(axis=0) <= slack
            b[live[done]] = probe[near[done]]
            a[live[done]] = b[live[done]] - 1


def _points(a: np.ndarray, apart: np.ndarray, probes: int) -> np.ndarray:
    """Up to ``probes`` keys evenly within each interval of ``apart`` keys above ``a``, ascending, each once."""
    steps = np.minimum(apart - np.uint64(1), np.uint64(probes))
    j = np.arange(1, probes + 1, dtype=np.uint64)[None, :]
    share, rest = np.divmod(apart, steps + np.uint64(1))
    places = a.view(np.uint64)[:, None] + share[:, None] * j + rest[:, None] * j // (steps + np.uint64(1))[:, None]
    return np.unique(places[j <= steps[:, None]].view(np.int64))


def _bytes_at_or_below(pairs: DataFrame, probes: np.ndarray) -> np.ndarray:
    """One pass: each partition sends its byte count for each gap between probes that it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(probes) + 1, np.int64)
        for batch in batches:
            gap = np.searchsorted(probes, batch.column(0).to_numpy(zero_copy_only=False), side="left")
            np.add.at(sums, gap, batch.column(1).to_numpy(zero_copy_only=False))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["gap", "bytes"])

    counted = pairs.select("key", "bytes").mapInArrow(run, "gap long, bytes long").groupBy("gap").agg(F.sum("bytes").alias("bytes"))
    sums = np.zeros(len(probes) + 1, np.int64)
    for gap, n in counted.collect():  # as many rows as probes at most
        sums[gap] = n
    return np.cumsum(sums)[:-1]


def shard_of(key: Column, cuts: np.ndarray, spark: SparkSession) -> Column:
    """The number of splitters below the key, by binary search in Arrow batches of keys; the splitters travel once to each executor."""
    if len(cuts) == 0:
        return F.lit(0)
    sent = spark.sparkContext.broadcast(cuts)

    @F.arrow_udf("int")
    def run(keys: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(sent.value, keys.to_numpy(zero_copy_only=False), side="left").astype(np.int32))

    return run(key)


def histogram_sort(
    docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard", shard_bytes: int = 64 << 20, least_shards: int = 16, tolerance: float = 0.0, probes: int = 15
) -> DataFrame:
    """``docs`` with ``shard_col``, each shard one partition, sorted by key. Shards: total bytes / ``shard_bytes``, ``least_shards`` at least."""
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != shard_col.lower()))
    key = F.coalesce(F.col(key_col).cast("long"), F.lit(LOWEST + 1))
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")).cast("long"), F.lit(0))
    pairs = materialise(docs.select(key.alias("key"), size.alias("bytes")), "pairs")
    total = pairs.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    shards = max(least_shards, -(-total // shard_bytes))
    cuts = splitters(pairs, shards, tolerance, probes) if total else np.zeros(0, np.int64)
    marked = docs.withColumn(shard_col, shard_of(key, cuts, docs.sparkSession).cast("int"))
    return marked.repartitionById(shards, F.col(shard_col)).sortWithinPartitions(shard_col, key_col)
