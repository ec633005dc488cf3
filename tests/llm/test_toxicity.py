"""The kernel against its definition, and the machine on held-out labels."""

from itertools import combinations

import numpy as np
import pytest

from tessera.llm import toxicity as X


def kernel(a, b):
    """Sum over common subsequences of three letters of decay to the lengths of both stretches."""
    return sum(X.DECAY ** (i[2] - i[0] + 1 + j[2] - j[0] + 1) for i in combinations(range(len(a)), 3) for j in combinations(range(len(b)), 3) if all(a[x] == b[y] for x, y in zip(i, j, strict=True)))


@pytest.mark.parametrize(("a", "b"), [("idiot", "idiot"), ("idiot", "ixdxiot"), ("abcabc", "aabbcc"), ("hello", "world"), ("aaaa", "aaa")])
def test_kernel(a, b):
    x, y = X.dense([a, b])
    assert float(x @ y) == pytest.approx(kernel(a, b) / (kernel(a, a) * kernel(b, b)) ** 0.5, abs=1e-5)


def test_folding():
    assert X.units("Idi0t! a b c d Ré1ve ...") == ["idiot", "réive", "abcd"]
    assert X.spelt("s o f t x".split()) == ["softx"]


def test_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    known = {r.doc_id: r.toxic for r in labels.collect()}
    train, held = labels.where("doc_id % 2 = 0"), {d: y for d, y in known.items() if d % 2}
    found = {r.doc_id for r in X.toxic(docs, train).collect()}
    bad, good = [d for d, y in held.items() if y == 1], [d for d, y in held.items() if y == 0]
    assert sum(d in found for d in bad) >= 0.85 * len(bad)
    assert sum(d in found for d in good) <= 0.05 * len(good)


def test_edge_rows(spark):
    clean = ["warm garden morning", "river boat harbour", "stone bridge market", "paper lantern window"]
    rows = [(i, f"{clean[i % 4]} line{i} calm" + (" you grobnik there" if i % 3 == 0 else "")) for i in range(90)]
    more = [(100, None), (101, ""), (102, "you gr0b-nik here"), (None, "grobnik"), (103, "calm words " * 20_000), (104, "calm river"), (104, "calm river")]
    docs = spark.createDataFrame([(d, t, 1.0, "u") for d, t in rows + more], "doc_id long, text string, score double, unit string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = X.toxic(docs, labels)
    assert got.columns == ["doc_id", "score", "unit"]
    for name in ("unit", "SCORE"):  # the id may be called as a column of the result
        clash = X.toxic(docs.drop("score", "unit").withColumnRenamed("doc_id", name), labels.withColumnRenamed("doc_id", name), id_col=name)
        assert len(set(map(str.lower, clash.columns))) == 3 and clash.count() == got.count()
    found = {r.doc_id for r in got.collect()}
    assert {i for i in range(0, 90, 3)} | {102, None} == found
    assert X.toxic(docs, labels.where("toxic = 0")).count() == 0 and X.toxic(docs.limit(0), labels).count() == 0
    assert np.isfinite([r.score for r in got.collect()]).all()


def test_long_words_are_learnt_to_their_end():
    bad, good = ["donaudampfschifftrottel", "donaudampfschiffidiotin"], ["donaudampfschiffkapitan", "donaudampfschiffmatrose"]
    machine = X._machine(bad, good, 64, 50)
    assert machine.margins(bad).min() > machine.margins(good).max()


def test_whole_query_by_brute_force(spark):
    """Every document scored from the landmarks' coefficients, unit by unit, without the folded table and the stretches' arrays."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    machine = X.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    marks, coefficients = machine.support
    basis, cache = X.dense(marks), {}

    def margin(unit):
        if unit not in cache:
            cache[unit] = max(float((X.dense([s]) @ basis.T @ coefficients)[0]) + machine.bias for s in X.windows(unit))
        return cache[unit]

    got = {r.doc_id: r for r in X.found_by(machine, docs).collect()}
    rows = docs.collect()
    assert got and len(got) < 0.3 * len(rows)
    for r in sorted(rows, key=lambda r: len(r.text or ""))[:120] + [r for r in rows if r.doc_id in got][:20]:
        best = max(((margin(u), u) for u in X.units(r.text)), key=lambda x: x[0], default=(-np.inf, ""))
        assert (r.doc_id in got) == (best[0] >= machine.threshold) or abs(best[0] - machine.threshold) < 1e-4
        if r.doc_id in got:
            assert got[r.doc_id].score == pytest.approx(best[0] - machine.threshold, abs=1e-3) and margin(got[r.doc_id].unit) == pytest.approx(best[0], abs=1e-3)


def test_copies_count_once():
    many = " ".join(f"wordof{chr(97 + i)}" for i in range(20))
    bags = [set(X.units(t)) for t in (many, many + " more", "else where")]
    assert X.copies([*bags, set(), bags[2]]) == [0, 0, 2, 3, 2]


def test_letters_beyond_ascii_have_codes_of_their_own():
    assert len(set(X._codes(["çéñüß"])[0].tolist())) >= 4 and X._codes(["дурак"]).min() >= 27
