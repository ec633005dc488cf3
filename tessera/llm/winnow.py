"""Benchmark decontamination by winnowing.

Of each text's hashes of k words in a row, the minimum of every window of w hashes is
kept (the rightmost of equal ones). Two texts that share span_words = w + k - 1 words in
a row share a window, hence a kept hash, so no shared span of that length is missed. Kept
hashes of documents and of benchmark items are joined, each hit is extended word by word
to both sides, and maximal shared spans of at least ``span_words`` words are returned.
A benchmark item of fewer words is sought whole: its span is all of it.

The join has two ways with the same result. While the benchmark's words take less than
``broadcast_bytes`` (8 bytes a word, counted before), its arrays go to every task and
documents are read once without a shuffle. Beyond that the documents' fingerprints and
the benchmark's meet in a shuffled join on the hash, and only texts that have a hit are
read again to extend it.

Words are runs of ASCII letters or digits, lower-cased, and non-ASCII characters.

Defined results: a null or empty text, or one without words, has no spans; an empty
benchmark contaminates nothing; null ids are reported as null (benchmark items without an
id are still sought); repeated rows of a document are each reported, and of a span that
occurs twice each occurrence; very long texts are read to their end; other columns are
neither read nor changed, whatever their names but ``__tessera_*``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import gram_hashes, materialise, slices, text_buffer, word_hashes

SPAN_WORDS, GRAM = 13, 7


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Ascending places of the kept hashes: each window's minimum, the rightmost of equals; a shorter array keeps its minimum."""
    if len(grams) == 0:
        return np.zeros(0, np.int64)
    window = min(window, len(grams))
    view = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.unique(np.arange(len(view)) + window - 1 - view[:, ::-1].argmin(axis=1))


class Fingerprints:
    """Benchmark items as arrays, and the search of a batch of texts for what they share with it."""

    def __init__(self, items: list[np.ndarray], span_words: int, gram: int) -> None:
        self.span, self.gram, self.items = span_words, gram, items
        # items too short for the guarantee are sought whole, by the hash of all their words
        self.short: dict[int, list[tuple[int, np.uint64]]] = {}
        hashes, owner, place = [], [], []
        for i, words in enumerate(items):
            if 0 < len(words) < span_words:
                self.short.setdefault(len(words), []).append((i, gram_hashes(words, len(words))[0]))
                continue
            grams = gram_hashes(words, gram)
            kept = winnow(grams, span_words - gram + 1)
            hashes.append(grams[kept])
            owner.append(np.full(len(kept), i, np.int64))
            place.append(kept)
        empty = np.zeros(0, np.int64)
        hashes, owner, place = (np.concatenate(x) if x else empty for x in (hashes, owner, place))
        order = np.argsort(hashes.astype(np.uint64), kind="stable")
        self.hashes, self.owner, self.place = hashes.astype(np.uint64)[order], owner[order], place[order]
        # a bitmap over the top bits decides nearly all look-ups
        self.bits = max(16, int(np.ceil(np.log2(len(self.hashes) + 1))) + 5)
        self.bitmap = np.zeros(1 << self.bits, bool)
        self.bitmap[(self.hashes >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def search(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, word in text, word in item, words) of the maximal shared spans; text t has words[first[t]:first[t + 1]]."""
        spans = set()
        grams = gram_hashes(words, self.gram)
        if len(self.hashes) and len(grams):
            text = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(grams)]
            whole = np.arange(len(grams)) + self.gram <= first[1:][text]
            # only texts with a hash of the benchmark's are winnowed: another has no hit
            maybe = np.flatnonzero(self.bitmap[(grams >> np.uint64(64 - self.bits)).astype(np.int64)] & whole)
            maybe = maybe[self.hashes[np.searchsorted(self.hashes, grams[maybe]).clip(max=len(self.hashes) - 1)] == grams[maybe]]
            for t in np.unique(text[maybe]).tolist():
                lo, hi = int(first[t]), int(first[t + 1])
                own = grams[lo : hi - self.gram + 1]
                kept = winnow(own, self.span - self.gram + 1)
                found = np.searchsorted(self.hashes, own[kept], side="left")
                until = np.searchsorted(self.hashes, own[kept], side="right")
                for at, a, b in zip(kept[until > found].tolist(), found[until > found].tolist(), until[until > found].tolist(), strict=True):
                    for hit in range(a, b):
                        span = extend(words[lo:hi], self.items[self.owner[hit]], at, int(self.place[hit]), self.gram)
                        if span and span[2] >= self.span:
                            spans.add((t, int(self.owner[hit]), *span))
        for n, items in self.short.items():
            grams = gram_hashes(words, n)
            at = np.flatnonzero(np.isin(grams, np.array([h for _, h in items], np.uint64)))
            for place in at.tolist():
                t = int(np.searchsorted(first, place, side="right")) - 1
                if place + n <= first[t + 1]:
                    spans |= {(t, i, place - int(first[t]), 0, n) for i, h in items if h == grams[place]}
        return sorted(spans)


def extend(a: np.ndarray, b: np.ndarray, i: int, j: int, n: int) -> tuple[int, int, int] | None:
    """The maximal common span around a[i:i+n] == b[j:j+n], as (start in a, start in b, words); None if those differ."""
    if not np.array_equal(a[i : i + n], b[j : j + n]):
        return None
    back = min(i, j)
    differ = np.flatnonzero(a[i - back : i][::-1] != b[j - back : j][::-1])
    left = int(differ[0]) if len(differ) else back
    ahead = min(len(a) - i - n, len(b) - j - n)
    differ = np.flatnonzero(a[i + n : i + n + ahead] != b[j + n : j + n + ahead])
    right = int(differ[0]) if len(differ) else ahead
    return i - left, j - left, left + n + right


def _schema(docs: DataFrame, items: DataFrame, id_col: str, item_col: str) -> T.StructType:
    long = T.LongType()
    return T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("item_id", items.schema[item_col].dataType),
        T.StructField("doc_word", long), T.StructField("item_word", long), T.StructField("n_words", long),
    ])


def shared_spans(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    span_words: int = SPAN_WORDS, gram: int = GRAM, broadcast_bytes: int = 64 << 20,
) -> DataFrame:
    """doc_id, item_id, doc_word and item_word (places from 0), n_words: every maximal shared span of ``span_words`` or more."""
    if not 0 < gram <= span_words:
        raise ValueError("0 < gram <= span_words")
    items = benchmark.select(F.col(item_col).alias("i"), F.col(item_text_col).cast("string").alias("t")).where("t is not null")
    size = items.select(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    # a word takes two bytes of text at least, eight as a hash
    if 4 * size <= broadcast_bytes:
        return _by_broadcast(docs, items, _schema(docs, benchmark, id_col, item_col), id_col, text_col, span_words, gram)
    return _by_join(docs, items, _schema(docs, benchmark, id_col, item_col), id_col, text_col, span_words, gram)


def _words_of(texts: list[str]) -> list[np.ndarray]:
    raw, offsets = text_buffer(pa.array(texts, pa.string()))
    words, first = word_hashes(raw, offsets)
    return [words[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, first word of each row) for ranges of the rows of a batch of (id, text)."""
    raw, offsets = text_buffer(batch.column(1))
    for lo, hi in slices(offsets):
        words, first = word_hashes(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        yield lo, words, first


def _by_broadcast(docs: DataFrame, items: DataFrame, schema: T.StructType, id_col: str, text_col: str, span_words: int, gram: int) -> DataFrame:
    rows = items.collect()  # its size was checked
    kind = pa.array([r["i"] for r in rows])
    prints = Fingerprints(_words_of([r["t"] for r in rows]), span_words, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, words, first in _batches(batch):
                if found := prints.search(words, first):
                    t, i, a, b, n = (pa.array(x, pa.int64()) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo).take(t), kind.take(i), a, b, n], names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def _by_join(docs: DataFrame, items: DataFrame, schema: T.StructType, id_col: str, text_col: str, span_words: int, gram: int) -> DataFrame:
    """Fingerprints of both sides meet by a shuffled join; a document with a hit meets the texts of the items it hit."""
    key = F.struct(F.xxhash64("t"), F.xxhash64(F.lit(1), "t"))
    texts = docs.select(F.col(id_col).alias("d"), F.col(text_col).cast("string").alias("t")).where("t is not null")

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, words, first in _batches(batch):
                rows, hashes = [], []
                for t in range(len(first) - 1):
                    own = words[first[t] : first[t + 1]]
                    grams = gram_hashes(own, gram)
                    if 0 < len(own) < span_words:
                        hashes.append(gram_hashes(own, len(own)))  # an item of so few words is sought whole
                    else:
                        hashes.append(np.unique(grams[winnow(grams, span_words - gram + 1)]))
                    rows.append(np.full(len(hashes[-1]), lo + t))
                at = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
                h = np.concatenate([*hashes, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(h)], names=["n", "h"])

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, first in _batches(batch):
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(first))], names=["n"])

    short = [r["n"] for r in items.select("i", "t").mapInArrow(lengths, "n long").where(f"n > 0 and n < {span_words}").distinct().collect()]

    def all_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from prints(iter([batch]))
            for lo, words, first in _batches(batch):
                for n in short:
                    grams = gram_hashes(words, n)
                    t = np.searchsorted(first, np.arange(len(grams)), side="right") - 1
                    whole = np.arange(len(grams)) + n <= first[1:][t]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + t[whole])), pa.array(grams[whole].view(np.int64))], names=["n", "h"])

    node = T.StructType([T.StructField("n", texts.select(key.alias("n")).schema["n"].dataType), T.StructField("h", T.LongType())])
    doc_prints = texts.select(key.alias("n"), "t").mapInArrow(all_prints, node)
    item_prints = items.select(key.alias("n"), "t").mapInArrow(prints, node).withColumnRenamed("n", "m")
    hits = doc_prints.join(item_prints, "h").select("n", "m").distinct()
    hits = materialise(hits, "hits")
    sides = hits.join(items.select(key.alias("m"), "i", F.col("t").alias("item")), "m").select("n", "i", "item")
    pairs = texts.select(key.alias("n"), "d", "t").join(sides, "n").select("d", "t", "i", "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Fingerprints] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                item = batch.column(3)[row].as_py()
                if item not in known:
                    if len(known) >= 64:
                        known.clear()
                    known[item] = Fingerprints(_words_of([item]), span_words, gram)
                (text,) = _words_of([batch.column(1)[row].as_py()])
                if found := known[item].search(text, np.array([0, len(text)])):
                    _, _, a, b, n = (pa.array(x, pa.int64()) for x in zip(*found, strict=True))
                    at = pa.array([row] * len(found))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), a, b, n], names=schema.names)

    return pairs.mapInArrow(run, schema)


def contaminated(text: str | F.Column, benchmark: DataFrame, item_text_col: str = "text", span_words: int = SPAN_WORDS, gram: int = GRAM):
    """A boolean column: whether a text shares a span with the benchmark, whose size the caller has checked."""
    rows = benchmark.select(F.col(item_text_col).cast("string").alias("t")).where("t is not null").collect()
    prints = Fingerprints(_words_of([r["t"] for r in rows]), span_words, gram)

    @F.arrow_udf(T.BooleanType())
    def run(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), bool)
        raw, offsets = text_buffer(texts)
        for lo, hi in slices(offsets):
            words, first = word_hashes(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            out[[lo + s[0] for s in prints.search(words, first)]] = True
        return pa.array(out)

    return run(text)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_text_col: str = "text",
    span_words: int = SPAN_WORDS, gram: int = GRAM, broadcast_bytes: int = 64 << 20,
) -> DataFrame:
    """The rows of ``docs``, all columns, that share no span of ``span_words`` words with the benchmark. Null texts stay."""
    size = benchmark.select(F.coalesce(F.sum(F.octet_length(F.col(item_text_col).cast("string"))), F.lit(0))).first()[0]
    text = F.col(text_col).cast("string")
    if 4 * size <= broadcast_bytes:
        return docs.where(~contaminated(text, benchmark, item_text_col, span_words, gram))
    keyed = docs.withColumn("__tessera_text", F.md5(text))
    rows = docs.select(F.md5(text).alias("m"), text.alias("t")).where("t is not null").dropDuplicates(["m"])
    spans = shared_spans(rows, benchmark, "m", "t", benchmark.columns[0], item_text_col, span_words, gram, 0)
    bad = spans.select(F.col("doc_id").alias("__tessera_bad")).distinct()
    return keyed.join(bad, F.col("__tessera_text") == F.col("__tessera_bad"), "left_anti").drop("__tessera_text")
