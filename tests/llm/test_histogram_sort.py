"""Splitters against a sort, and the exchange against its definition."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import histogram_sort as H


def cuts_by_sort(pairs, shards):
    total, out = sum(b for _, b in pairs), []
    for i in range(1, shards):
        target, before = -(-total * i // shards), 0
        for k in sorted({k for k, _ in pairs}):
            before += sum(b for x, b in pairs if x == k)
            if before >= target:
                out.append(k)
                break
    return out


def test_splitters(spark):
    for pairs in ([(i * 37 % 101, i % 9) for i in range(200)], [(5, 10)] * 20, [(-(2**60), 3), (2**60, 4), (0, 1)], [(1, 0), (2, 7)]):
        frame = spark.createDataFrame(pairs, "key long, bytes long")
        assert H.splitters(frame, 6).tolist() == H.splitters(frame, 6, probes=1).tolist() == cuts_by_sort(pairs, 6)
    loose = H.splitters(spark.createDataFrame([(i, 1) for i in range(1000)], "key long, bytes long"), 10, tolerance=0.1)
    assert all(abs(c + 1 - 100 * (i + 1)) <= 10 for i, c in enumerate(loose))


def test_points():
    for a, b, n in ((-(2**63), 2**63 - 1, 15), (0, 2, 15), (0, 17, 4), (-5, 11, 15)):
        got = H._points(np.array([a], np.int64), np.array([b - a], np.uint64), n).tolist()
        assert len(got) == min(n, b - a - 1) and all(a < x < b for x in got)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-20, 20), min_size=1, max_size=12, unique=True), st.lists(st.integers(-25, 25), min_size=1, max_size=20))
def test_shard_of(spark, cuts, keys):
    cuts = sorted(cuts)
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", H.shard_of(F.col("k"), np.array(cuts, np.int64), spark).alias("s")).collect()
    assert all(r.s == sum(c < r.k for c in cuts) for r in rows)


def test_edge_rows(spark):
    rows = [(i % 40, "t" * (i % 13), 9) for i in range(200)] + [(None, "null key", 9), (7, None, 9), (7, "", 9), (8, "long " * 30_000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, SHARD int")
    out = H.histogram_sort(docs, least_shards=5)
    assert out.columns == ["doc_id", "text", "shard"]
    got = out.withColumn("p", F.spark_partition_id()).collect()
    assert len(got) == len(rows) and all(r.p == r.shard for r in got)
    keys = [(r.shard, -1 if r.doc_id is None else r.doc_id) for r in got]
    assert keys == sorted(keys)
    for s in range(4):
        assert max([k for x, k in keys if x == s], default=-2) < min([k for x, k in keys if x > s], default=99)
    assert {r.shard for r in H.histogram_sort(docs.where("text is null")).collect()} == {0}
    assert H.histogram_sort(docs.limit(0)).count() == 0
