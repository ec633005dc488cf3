"""The label model on votes of known accuracy, and the classifier on held-out labels."""

import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import quality as Q
from tessera.llm.common import text_buffer

WORDS = st.sampled_from("the The de und für A. b, ... !? é… \u2003 \u00a0 \u3000 \n \n\n $$ 漢字 😀 ab12 x x x \x1c \x85 --- «a» ١".split(" ") + [" ", "", "\r\n", "\u2028"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(WORDS, max_size=60).map(" ".join), st.lists(WORDS, max_size=90).map("".join), st.text(max_size=30)), max_size=6))
def test_measures_of_batches(texts):
    got = Q.measures_of(*text_buffer(pa.array(texts, pa.string())))
    for row, text in zip(got, texts, strict=True):
        want = Q.measures(text)
        assert np.isnan(row).all() if want is None else row.tolist() == pytest.approx(want)


def naive_votes(values):
    return "".join("b" if v >= bad else "g" if v <= good else "a" for v, (_, bad, good) in zip(values, Q.LABELLERS, strict=True)) if values else "b" * len(Q.LABELLERS)


def naive_posteriors(patterns, rounds=200):
    """Expectation-maximisation over documents, one at a time."""
    post = [((p.count("g") + 1) / (p.count("g") + p.count("b") + 2)) for p in patterns]
    for _ in range(rounds):
        prior = (sum(post) + 1) / (len(post) + 2)
        chance = {}
        for y in (0, 1):
            weight = [p if y else 1 - p for p in post]
            for i in range(len(Q.LABELLERS)):
                of = {v: 1 + sum(w for w, x in zip(weight, patterns, strict=True) if x[i] == v) for v in "abg"}
                chance.update({(y, i, v): c / sum(of.values()) for v, c in of.items()})
        score = [[math.log(prior if y else 1 - prior) + sum(math.log(chance[y, i, v]) for i, v in enumerate(p)) for y in (0, 1)] for p in patterns]
        new = [1 / (1 + math.exp(a - b)) for a, b in score]
        if max(abs(a - b) for a, b in zip(new, post, strict=True)) < 1e-9:
            return new
        post = new
    return post


def test_whole_query_by_brute_force(spark):
    """Votes, posteriors and scores of every document, one text and one feature at a time."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    told = [naive_votes(Q.measures(r.text)) for r in rows]
    counts = {r["pattern"]: r["count"] for r in Q.vote_counts(docs).collect()}
    assert counts == {p: told.count(p) for p in set(told)}
    model, scorer = Q.fit(docs)
    for p, y in zip(told, naive_posteriors(told), strict=True):
        assert model.posterior[p] == pytest.approx(y, abs=1e-6)
    got = {r.doc_id: r.score for r in Q.accepted_scores(docs).collect()}
    for r in rows:
        slots, x = Q.features(r.text)
        z = scorer.bias + sum(scorer.weights[s] * v for s, v in zip(slots.tolist(), x.tolist(), strict=True))
        score = 1 / (1 + math.exp(-z)) if len(slots) else 0.0
        assert got.get(r.doc_id) == (pytest.approx(score, abs=2e-6) if score >= 0.5 else None)


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(5)
    truth = rng.random(40_000) < 0.7
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.9, 0.8])
    counts = {}
    for y in truth:
        hit = rng.random(9) < right
        pattern = "".join("gb"[int(h != y)] if rng.random() < 0.6 else "a" for h in hit)
        counts[pattern] = counts.get(pattern, 0) + 1
    model = Q.LabelModel(counts)
    assert abs(model.prior - 0.7) < 0.03
    assert np.abs(np.array(list(model.accuracies().values())) - right).max() < 0.05


def test_held_out_labels(spark):
    """No label is used in training, so all are held out."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    kept = {r.doc_id for r in Q.accepted_scores(docs).collect()}
    good, bad = [d for d, y in labels.items() if y == 1], [d for d, y in labels.items() if y == 0]
    assert sum(d in kept for d in good) >= 0.95 * len(good)
    assert sum(d not in kept for d in bad) >= 0.8 * len(bad)


def test_edge_rows(spark):
    prose = "the cat of the house is in the garden and it was warm for a day in spring so the dog came by\nit left with the ball on a hill"
    junk = "$$ %% ^^ &&&& #### ~~ " * 30
    rows = [(1, prose), (1, prose), (None, prose), (2, None), (3, ""), (4, " \n "), (5, junk), (6, (prose + " then ") * 3_000 + junk)] + [(10 + i, f"{prose} and number {i} of them {i * i}") for i in range(30)]
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, score string")
    kept = Q.accepted(docs)
    assert kept.columns == docs.columns
    left = [r.doc_id for r in kept.collect()]
    assert not {2, 3, 4, 5} & set(left) and left.count(1) == 2 and left.count(None) == 1
    assert sorted(str(r.doc_id) for r in Q.accepted_scores(docs).collect()) == sorted(map(str, left))
    assert Q.accepted(docs.limit(0)).count() == 0
    assert Q.accepted_scores(docs.drop("score").withColumnRenamed("doc_id", "score"), id_col="score").columns == ["score", "score_"]
