"""Near-dedup against brute force: all pairs by exact probability Jaccard, joined into groups."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import probminhash as P
from tessera.llm.common import text_buffer, word_hashes


def sets_of(texts):
    raw, offsets = text_buffer(pa.array(texts, pa.string()))
    words, first = word_hashes(raw, offsets)
    text, grams, counts = P.shingles(words, first, P.SHINGLE)
    return [(grams[text == i], counts[text == i]) for i in range(len(texts))]


def groups_by_brute_force(rows, threshold=P.THRESHOLD):
    """rows: (id, text) -> id: survivor of every row that goes."""
    rows = [(d, t) for d, t in rows if t is not None]
    sets, root = sets_of([t for _, t in rows]), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][1] == rows[j][1]
            if same or P.probability_jaccard(*sets[i], *sets[j]) >= threshold:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    members = {}
    for i, (d, _) in enumerate(rows):
        members.setdefault(find(i), []).append(d)
    return {d: min(ids) for ids in members.values() for d in ids if d != min(ids)}


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.duplicate_of for r in P.near_duplicates(docs).collect()}
    want = groups_by_brute_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert want
    assert len(set(got) & set(want)) >= 0.9 * len(want)
    assert not set(got) - set(want)


def test_edge_rows(spark):
    long = " ".join(f"word{i % 997}" for i in range(120_000))
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, None), (5, ""), (6, ""), (7, "!!"), (None, "a b c d e f g"), (8, long), (9, long + " more"), (10, "lone words stand here"), (1, "a b c d e f g")]
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, m string, root string")
    kept = P.deduplicate(docs)
    assert kept.columns == docs.columns
    left = sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect())
    assert left == [1, 3, 4, 5, 7, 8, 10]
    dropped = sorted((r.doc_id if r.doc_id is not None else -1, r.duplicate_of) for r in P.near_duplicates(docs).collect())
    assert dropped == [(-1, 1), (1, 1), (2, 1), (6, 5), (9, 8)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert P.near_duplicates(docs).count() == 0 and P.deduplicate(docs).count() == 0


def test_many_copies_and_shared_passage(spark):
    rng = np.random.default_rng(3)
    passage = " ".join(f"p{i}" for i in range(60))
    base = [f"b{x}" for x in rng.integers(0, 5000, 120)]
    near = [" ".join([*base[:i], f"new{i}", *base[i + 1 :]]) for i in range(100)]
    apart = [" ".join(f"z{x}" for x in rng.integers(0, 50_000, 150)) + " " + passage for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(near + apart)), "doc_id long, text string")
    got = {r.doc_id: r.duplicate_of for r in P.near_duplicates(docs).collect()}
    assert got == dict.fromkeys(range(1, 100), 0)


def test_every_two_members_of_a_split_bucket_meet(spark):
    rows = [(1, 2, 1), *((7, i, 10) for i in range(10))]
    sized = spark.createDataFrame(rows, "key long, m long, n long")
    met = {}
    for r in P._blocked(sized, 3).collect():
        met.setdefault(r.key, set()).add(r.m)
    assert met.pop(1) == {2}
    assert {frozenset((a, b)) for ms in met.values() for a in ms for b in ms if a < b} == {frozenset((a, b)) for a in range(10) for b in range(a)}


def test_split_buckets_give_the_same_groups(spark):
    rng = np.random.default_rng(3)
    base = [f"b{x}" for x in rng.integers(0, 5000, 120)]
    near = [" ".join([*base[:i], f"new{i}", *base[i + 1 :]]) for i in range(60)]
    apart = [" ".join(f"z{x}" for x in rng.integers(0, 50_000, 150)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(near + apart)), "doc_id long, text string")
    got = {r.doc_id: r.duplicate_of for r in P.near_duplicates(docs, block=7).collect()}
    assert got == dict.fromkeys(range(1, 60), 0)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 9)), max_size=20), st.lists(st.tuples(st.integers(0, 30), st.integers(1, 9)), max_size=20))
def test_probability_jaccard(a, b):
    a, b = dict(a), dict(b)
    exact = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())
    arrays = [np.array(x, t) for s in (a, b) for x, t in ((sorted(s), np.uint64), ([s[k] for k in sorted(s)], np.uint32))]
    assert P.probability_jaccard(*arrays) == pytest.approx(exact)


def test_signatures_estimate(spark):
    texts = [" ".join(f"w{i}" for i in range(400)), " ".join(f"w{i}" for i in range(80, 480))]
    sets = sets_of(texts)
    parts = [(np.full(len(g), i), g, c) for i, (g, c) in enumerate(sets)]
    sig = P.signatures(*(np.concatenate(x) for x in zip(*parts, strict=True)), 2, 2048)
    assert (sig[0] == sig[1]).mean() == pytest.approx(P.probability_jaccard(*sets[0], *sets[1]), abs=0.05)


def test_bucket_links_compare_all_that_are_not_done():
    key = np.array([1, 1, 1, 1, 2, 2], np.int64)
    sig = np.array([[1] * 8, [2] * 8, [2] * 8, [1] * 8, [3] * 8, [4] * 8], np.uint8)
    a, b = P.bucket_links(key, sig, 0.5, 0.9)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(2, 1), (3, 0)]


def test_bucket_links_compare_done_members_with_the_rest():
    sig = np.zeros((302, 160), np.uint8)
    for i in range(1, 301):
        sig[i, [(i + j * 7) % 160 for j in range(50)]] = i % 255 + 1  # share of 0.69 with the leader
    sig[301] = 255
    sig[301, :90] = sig[200, :90]  # near one variant, not the leader
    assert (sig[301] == sig[0]).mean() < 0.42
    a, b = P.bucket_links(np.zeros(302, np.int64), sig, 0.34, 0.62)
    assert (301, 200) in zip(a.tolist(), b.tolist(), strict=True)


def test_copies_near_one_variant_of_a_large_group(spark):
    rng = np.random.default_rng(5)

    def edited(words, n, name):
        words = list(words)
        for i in rng.choice(len(words), n, replace=False):
            words[i] = f"{name}e{i}"
        return words

    base = [f"b{i}" for i in range(400)]
    variants = [edited(base, 12, f"v{k}") for k in range(300)]
    copies = [edited(variants[7 * k], 40, f"c{k}") for k in range(40)]
    rows = list(enumerate(" ".join(w) for w in variants + copies))
    got = {r.doc_id: r.duplicate_of for r in P.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = groups_by_brute_force(rows)
    late = [d for d in want if d >= 300]
    assert len(late) >= 20 and not set(got) - set(want)
    assert sum(d in got for d in late) >= 0.88 * len(late)
