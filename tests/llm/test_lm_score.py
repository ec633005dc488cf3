"""Cross-parsing against a suffix automaton of each row's own reference, and that against search."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import lm_score as L
from tessera.llm.common import text_buffer, word_hashes


class SuffixAutomaton:
    """Of several texts; no factor crosses from one text to the next."""

    def __init__(self, texts):
        self.next, self.length, self.link = [{}], [0], [-1]
        for text in texts:
            last = 0
            for c in text:
                last = self._step(last, c)

    def _clone(self, p, q, c):
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _step(self, last, c):
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
        new, p = len(self.next), last
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return new

    def phrases(self, text):
        state = n = 0
        for c in text:
            to = self.next[state].get(c)
            if to is None:
                if state:
                    n += 1
                    to = self.next[0].get(c)
                if to is None:
                    n += 1
                    to = 0
            state = to
        return n + (state > 0)


def phrases_by_search(references, text):
    n = i = 0
    while i < len(text):
        m = 1
        while i + m < len(text) and any(text[i : i + m + 1] in r for r in references):
            m += 1
        i, n = i + m, n + 1
    return n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", max_size=14), max_size=4), st.text("abcd", max_size=25))
def test_the_automaton_of_these_tests(references, text):
    assert SuffixAutomaton(references).phrases(text) == phrases_by_search(references, text)


def test_own_phrases():
    assert [L.own_phrases(x) for x in ("", "a", "aa", "aaa", "abab", "abababab")] == [0, 1, 2, 2, 3, 5]


def test_scores():
    assert L.scores(0, 0, 0) == (None, None)
    assert L.scores(8, 4, 2) == (pytest.approx(4 * 3 / 8), pytest.approx(4 * 3 / 8 - 2 * math.log2(2) / 8))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 12), st.lists(st.integers(0, 2**64 - 1), max_size=40))
def test_packing(bits, names):
    names = np.unique(np.array(names, np.uint64))
    bucket, parts, flags = L.packed(names, np.arange(len(names)).astype(np.uint8), bits)
    back = [(b << (64 - bits) if bits else 0) | (int(x) << (24 - bits)) for b, part in zip(bucket, parts, strict=True) for x in L.unpacked(part)]
    assert back == [int(x) >> (24 - bits) << (24 - bits) for x in names]
    assert b"".join(flags) == bytes(range(len(names)))


def segments(texts):
    words, first = word_hashes(*text_buffer(pa.array(texts, pa.string())))
    end, out = L.cuts(words, first).tolist(), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        own = []
        while a < b:
            own.append(tuple(words[a : end[a]].tolist()))
            a = end[a]
        out.append(own)
    return out


def brute_force(rows, good):
    """(id, words, own, cross, good phrases) of every row, sorted."""
    split, out = segments([t for _, t in rows]), []
    for i, (d, _) in enumerate(rows):
        whole = SuffixAutomaton([s for j, own in enumerate(split) for s in own if j != i])
        fine = SuffixAutomaton([s for j, own in enumerate(split) for s in own if j != i and rows[j][0] in good and rows[j][0] is not None])
        own = [w for s in split[i] for w in s]
        out.append((d, len(own), L.own_phrases(own), sum(map(whole.phrases, split[i])), sum(map(fine.phrases, split[i]))))
    return sorted(out, key=str)


def got(frame):
    return sorted(((r.doc_id, r.n_symbols, r.own_phrases, r.cross_phrases, r.good_phrases) for r in frame.collect()), key=str)


ROWS = [(i, " ".join("uvwxyz"[(i * j * j + j) % 6] for j in range(40))) for i in range(30)] + [
    (90, None), (91, ""), (None, "u v w"), (None, "u v w"), (92, "u " * 9_000), (3, "u v w x"), (3, "u v w x"), (93, "--- ..."), (94, "once only " + "a lone passage that two rows share " * 3),
    (95, "a lone passage that two rows share " * 3 + "and no more"),
]
GOOD = {*range(0, 30, 2), 92, 3}


@pytest.mark.parametrize("sizes", [{}, {"batch_bytes": 400, "bucket_bytes": 100}])
def test_edge_rows_against_automata(spark, sizes):
    """The same whatever the batches and buckets; columns of clashing names, repeated rows, nulls, a very long text."""
    docs = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in ROWS], "doc_id long, text string, batch int, quality int, flags string")
    labels = spark.createDataFrame([(i, 1) for i in sorted(GOOD)] + [(3, 0), (None, 1), (5, None), (92, 1)], "doc_id long, quality int")
    found = L.score(docs, labels, **sizes)
    assert got(found) == brute_force(ROWS, GOOD)
    assert all((r.relative_entropy is None) == (r.good_entropy is None) == (r.n_symbols == 0) for r in found.collect())
    if not sizes:
        assert L.score(docs.limit(0), labels).count() == 0
        assert all(r.good_phrases == r.n_symbols for r in L.score(docs, labels.limit(0)).collect())


def test_whole_table_against_automata(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()][:60]  # an automaton a row takes its time
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    some = docs.where(docs.doc_id.isin([d for d, _ in rows]))
    assert got(L.score(some, labels, batch_bytes=40_000)) == brute_force(rows, good)


def families():
    """Rows by families without a common word: near and exact copies, passages at any place, short periods."""
    draw, out = random.Random(2), []
    for f in range(60):
        word = [f"f{f}w{i}" for i in range(draw.choice((2, 3, 30, 400)))]
        base, rows = draw.choices(word, k=draw.choice((20, 90, 300))), []
        for _ in range(draw.randint(2, 7)):
            kind = draw.randrange(5)
            if kind == 0:
                own = list(base)
            elif kind == 1:
                own = [x if draw.random() > 0.03 else draw.choice(word) for x in base]
            elif kind == 2:
                a, b = sorted(draw.choices(range(len(base) + 1), k=2))
                own = draw.choices(word, k=draw.randint(0, 9)) + base[a:b] + draw.choices(word, k=draw.randint(0, 9))
            elif kind == 3:
                period = draw.randint(1, 11)
                own = draw.choices(word, k=draw.randint(0, 2)) + (base[:period] * 200)[: draw.randint(1, 200)] + draw.choices(word, k=draw.randint(0, 2))
            else:
                a = draw.randrange(len(base))
                own = base[a:] + base[:a]
            rows.append((len(out) * 10 + len(rows), " ".join(own)))
        out.append(rows)
    return out


@pytest.mark.parametrize("sizes", [{}, {"batch_bytes": 20_000, "bucket_bytes": 3_000}])
def test_phrases_of_any_length_against_automata(spark, sizes):
    """No phrase ends but where the other rows differ: before texts were read whole, the two copies of the last row had 365 phrases each."""
    one = (10_000, " ".join(f"once{i}" for i in range(3_000)))
    every = [*families(), [one, (10_001, one[1])]]
    rows, draw = [r for f in every for r in f], random.Random(3)
    good = {d for d, _ in rows if draw.random() < 0.4}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = got(L.score(docs, spark.createDataFrame([(d, 1) for d in sorted(good)], "doc_id long, quality int"), **sizes))
    wanted = sorted((r for f in every for r in brute_force(f, good)), key=str)
    assert found == wanted
    assert [(cross, n) for d, n, _, cross, _ in found if d >= 10_000] == [(1, 3_000)] * 2


def test_one_word_texts_ask_for_few_names():
    """A row of one word, at any length, asks for as many names as it has words, not for the square."""
    n, m = 40_000, 1_024
    at = np.arange(n)
    begins = at[: n - m + 1]
    row = L.Stretches.of(m, np.array([0, n]), np.array([0], np.int8), at, np.full(n, 7, np.uint32), begins, np.full(len(begins), 5, np.uint64), np.full(len(begins), L.ELSEWHERE + L.BEFORE + L.AFTER, np.uint8))
    assert row.asks <= 2 * n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 40), st.integers(0, 2**64 - 1), st.integers(2**64 - 20, 2**64 - 1)), max_size=60))
def test_ascending(names):
    """Also names that differ in the bits only which the places take."""
    names = np.array(names, np.uint64)
    assert L.ascending(names).tolist() == np.argsort(names, kind="stable").tolist()


@pytest.mark.parametrize("size", [1, 30, 100, 10_000])
def test_batches_hold_every_row_once(size):
    """Rows of one batch stay below its size, but for one that is larger itself."""
    texts = [None, "", "a b a", "b c " * 40, "x", None, "--", "d", "a b a", "e f g " * 9]
    tables = [pa.record_batch({"d": list(range(a, b)), "t": pa.array(texts[a:b], pa.string()), "good": [1] * (b - a)}) for a, b in ((0, 3), (3, 3), (3, 10))]
    found = list(L.batches(iter(tables), size, 7 << 32))
    assert [r["batch"] for r in found] == [(7 << 32) + i for i in range(len(found))]
    assert all(r["bytes"] <= size or len(L._Batch(r).ids) == 1 for r in found)
    made = [L._Batch(r) for r in found]
    assert [d for b in made for d in b.ids.to_pylist()] == list(range(10))
    words, first = word_hashes(*text_buffer(pa.array(texts, pa.string())))
    assert np.concatenate([b.words for b in made]).tolist() == words.tolist()
    assert np.concatenate([np.diff(b.first) for b in made]).tolist() == np.diff(first).tolist()


def shuffled(spark, after=-1):
    """(last stage, bytes of shuffle written by the stages after ``after``)."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    told = [(s.stageId(), s.shuffleWriteBytes()) for s in (stages.apply(i) for i in range(stages.size()))]
    return max([x for x, _ in told], default=-1), sum(b for x, b in told if x > after)


def test_exchanges_are_small(spark):
    """Bytes exchanged for one of text: 4.9 when batches were exchanged for each question and every name had the words beside it, 2.7 after."""
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    text = sum(len((r.text or "").encode()) for r in docs.select("text").collect())
    before, _ = shuffled(spark)
    L.score(docs, labels).write.format("noop").mode("overwrite").save()
    assert shuffled(spark, before)[1] < 3.5 * text
