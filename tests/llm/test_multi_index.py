"""Classes and links of near vectors against all pairs."""

import numpy as np
import pytest

from tessera.llm import multi_index as M


def brute_force(ids, vectors, least=M.SIMILARITY):
    """{place: (class, links)} and the number of links."""
    x = np.array(vectors, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= least
    np.fill_diagonal(near, True)
    of = np.arange(len(ids))
    while True:
        new = np.array([of[row].min() for row in near])
        if (new == of).all():
            break
        of = new
    least_id = {c: min(ids[i] for i in np.flatnonzero(of == c)) for c in set(of.tolist())}
    return {i: (least_id[of[i]], int(near[i].sum()) - 1) for i in range(len(ids))}


def frame(spark, vectors):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors.astype(np.float32))], "vec_id long, embedding array<float>")


def got(rows):
    return {r.vec_id: (r.class_id, r.links) for r in rows.collect()}


def test_recall_on_noisy_copies(spark):
    """Pairs of all similarities about the bound and above it: at least the target's share of links is found, none is made up."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(2500, 32))
    near = base[:1200] + rng.normal(size=(1200, 32)) * rng.uniform(0.05, 0.33, size=(1200, 1))
    vectors = np.concatenate([base, near]).astype(np.float32)
    want, found = brute_force(range(len(vectors)), vectors), got(M.near_duplicates(frame(spark, vectors), per_cell=8))
    links, wanted = sum(n for _, n in found.values()), sum(n for _, n in want.values())
    assert wanted > 1500 and M.TARGET_RECALL * wanted - 6 <= links <= wanted
    assert all(found[i][1] <= want[i][1] for i in want)


@pytest.mark.parametrize("block", [M.BLOCK, 16])
def test_a_hot_group(spark, block):
    """A third of all rows near one another, all different, and another third equal; split or not."""
    rng = np.random.default_rng(2)
    centre, same = rng.normal(size=(2, 24))
    vectors = np.concatenate([rng.normal(size=(150, 24)), centre + rng.normal(size=(150, 24)) * 0.1, np.repeat(same[None], 150, axis=0)])
    assert got(M.near_duplicates(frame(spark, vectors), per_cell=50, block=block)) == brute_force(range(450), vectors.astype(np.float32))


def test_block_links():
    rng = np.random.default_rng(3)
    for size, dims in ((40, 3), (700, 4), (1, 2), (0, 2)):
        x = rng.normal(size=(size, dims)).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        home, n = rng.random(size) < 0.7, rng.integers(1, 4, size)
        for inside in (True, False):
            near = (x.astype(float) @ x.astype(float).T >= 0.9) & (home[:, None] != home[None, :] if not inside else home[:, None] | home[None, :])
            np.fill_diagonal(near, False)
            links, parent = M.block_links(x, home, n, 0.9, inside)
            assert (links == near @ n).all()
            label, wanted = np.arange(size), np.arange(size)
            tree = np.zeros((size, size), bool)
            tree[np.flatnonzero(parent >= 0), parent[parent >= 0]] = True
            for _ in range(size):
                label = np.array([min(label[i], label[tree[i] | tree[:, i]].min(initial=size)) for i in range(size)])
                wanted = np.array([min(wanted[i], wanted[near[i]].min(initial=size)) for i in range(size)])
                if size > 100:
                    break
            assert size > 100 or (label == wanted).all()


def test_multi_sequence_order():
    rng = np.random.default_rng(4)
    a, b = rng.random((5, 6)), rng.random((5, 7))
    q, i, j = M.multi_sequence(a, b, 0.8)
    assert set(zip(q, i, j, strict=True)) == {(x, y, z) for x in range(5) for y in range(6) for z in range(7) if a[x, y] + b[x, z] <= 0.8}
    order = list(zip(q, a[q, i] + b[q, j], strict=True))
    assert order == sorted(order)


def test_edge_rows(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0, 0.0, 1.0]), (2, [1.0, 0.0, 0.0, 1.0]), (2, [1.0, 0.0, 0.0, 1.0]), (3, None), (4, [0.0] * 4), (5, [1.0, nan, 0.0, 0.0]), (6, [1.0]), (7, [2.0, 0.0, 0.0, 2.0]), (None, [1.0, 0.0, 0.0, 1.0]), (8, [0.0, 1.0, 0.0, 0.0]), (9, [1.0, None, 0.0, 1.0]), (10, []), (None, None)]
    table = spark.createDataFrame([(i, v, 0.5, "x") for i, v in rows], "vec_id long, embedding array<float>, links double, m string")
    near = [(1, 1, 4), (2, 1, 4), (2, 1, 4), (7, 1, 4), (None, 1, 4)]
    alone = [(i, i, 0) for i in (3, 4, 5, 6, 8, 9, 10, None)]
    assert sorted(map(tuple, M.near_duplicates(table).collect()), key=str) == sorted(near + alone, key=str)
    assert M.near_duplicates(table.limit(0)).count() == 0
    assert sorted(tuple(r) for r in M.near_duplicates(table.where("vec_id in (3, 8)")).collect()) == [(3, 3, 0), (8, 8, 0)]
