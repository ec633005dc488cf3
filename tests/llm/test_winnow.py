"""Shared spans against brute force over all pairs of places."""

import re

import pytest

from tessera.llm import winnow as W


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def spans_by_brute_force(docs, items, least=W.SPAN_WORDS):
    out = set()
    for d, text in docs.items():
        a = words(text)
        for k, item in items.items():
            b = words(item)
            n = min(least, len(b))
            if not n:
                continue
            where = {}
            for j in range(len(b) - n + 1):
                where.setdefault(tuple(b[j : j + n]), []).append(j)
            for i in range(len(a) - n + 1):
                for j in where.get(tuple(a[i : i + n]), ()):
                    if i and j and a[i - 1] == b[j - 1]:
                        continue
                    m = n
                    while i + m < len(a) and j + m < len(b) and a[i + m] == b[j + m]:
                        m += 1
                    out.add((d, k, i, j, m))
    return out


DOCS = [
    (1, " ".join(f"w{i}" for i in range(40))), (2, None), (3, ""), (4, "... !"), (5, "x " + " ".join(f"W{i}" for i in range(13))), (6, " ".join(f"w{i}" for i in range(12))),
    (7, "say short item now"), (8, ("w1 " * 50).strip()), (9, " ".join(f"q{i}" for i in range(60_000)) + " " + " ".join(f"w{i}" for i in range(20))), (None, " ".join(f"w{i}" for i in range(14))),
]
ITEMS = [(10, " ".join(f"w{i}" for i in range(25))), (11, "short item"), (12, None), (13, ""), (14, "w1 " * 20)]


@pytest.mark.parametrize("broadcast_bytes", [64 << 20, 0])
def test_edge_rows_in_both_ways(spark, broadcast_bytes):
    docs = spark.createDataFrame([(d, t, 1) for d, t in DOCS], "doc_id long, text string, item_id int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {tuple(r) for r in W.shared_spans(docs, items, broadcast_bytes=broadcast_bytes).collect()}
    assert got == spans_by_brute_force(dict(DOCS), dict(ITEMS))
    kept = W.decontaminate(docs, items, broadcast_bytes=broadcast_bytes)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert W.shared_spans(docs, items).count() == 0 and W.shared_spans(some, items).count() == 0 and W.decontaminate(some, items).count() == 1
