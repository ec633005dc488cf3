"""MinHash near-dedup with ProbMinHash signatures.

A text is the weighted set of its shingles of k words, weighted by how often they occur.
Each shingle has a Poisson process of rate its weight: arrival times are running sums of
exponential variates over the weight, drawn from the shingle's hash, and each arrival
falls on a random signature component, which keeps the earliest arrival. A shingle's
process ends as soon as its next arrival is later than every component's time. The share
of equal components estimates the probability Jaccard similarity
J_P = sum over shared d of 1 / sum over e of max(a_e / a_d, b_e / b_d).

Bands of ``rows`` components are bucket keys; a text is in as many buckets as bands.
Buckets of several texts are sorted into tasks with the members' signatures, one byte a
component. There the first member leads: every member whose share of equal components is
at most four deviations below the threshold is a candidate with it, and one that is three
above is done in this bucket. What is not done goes on with the next leader, all buckets
of a batch at once, so no candidate is dropped by a cap and near copies by the thousand
cost one comparison each. As nearness is not transitive, the done members of a leader are
then compared with the members of other leaders, until a share that high joins the two. A bucket of
more than ``block`` members is split into blocks by their digests, and every two blocks meet in a
task of their own: no bucket is held whole, each pair meets somewhere, and the members are sent
once for every other block. Candidates are verified by the exact J_P of their shingle sets,
and verified links are joined into groups by alternating large-star and small-star steps.
Equal texts are one node throughout and are never compared.

Defined results: null texts are never near anything and always stay; texts without a
word are near only equal texts; of a text of under k words the whole is the shingle; very long
texts are read to their end; a
group's survivor is its smallest id (nulls last), ties by the text's digest; of wholly
repeated rows one stays; an empty table has no groups; other columns are carried along
and may have any name but ``__tessera_*``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import free_names, gram_hashes, materialise, mix, slices, text_buffer, word_hashes

SHINGLE, BANDS, ROWS, THRESHOLD = 3, 40, 4, 0.5
#: Members of a bucket that a task compares at most with as many others.
BLOCK = 1 << 16
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the distinct shingles of consecutive texts, by text and hash."""
    sizes = np.diff(first)
    grams = gram_hashes(words, k)
    text = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(grams)) + k <= first[1:][text[: len(grams)]]
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    whole = np.array([gram_hashes(words[first[t] : first[t + 1]], int(sizes[t]))[0] for t in short], np.uint64)
    text = np.concatenate([text[: len(grams)][inside], short])
    grams = np.concatenate([grams[inside], whole])
    order = np.lexsort((grams, text))
    text, grams = text[order], grams[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (grams[1:] != grams[:-1])
    at = np.flatnonzero(new)
    return text[at], grams[at], np.diff(at, append=len(text))


def signatures(text: np.ndarray, grams: np.ndarray, counts: np.ndarray, n: int, size: int) -> np.ndarray:
    """(n, size) uint64: for each component the shingle of the earliest arrival; zeros for a text without shingles."""
    time = np.full(n * size, np.inf)
    who = np.zeros(n * size, np.uint64)
    x = np.zeros(len(text))
    live, step = np.arange(len(text)), 0
    worst = np.full(n, np.inf)
    with np.errstate(over="ignore"):
        while len(live):
            step += 1
            r = mix(grams[live] + np.uint64(step) * _GOLD)
            # 53 bits for the exponential variate, an independent hash for the component
            x[live] -= np.log((r >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / counts[live]
            live = live[x[live] < worst[text[live]]]
            if len(live) == 0:
                break
            place = mix(grams[live] ^ (np.uint64(step) * np.uint64(0xD6E8FEB86659FD93)))
            slot = text[live] * size + ((place >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
            better = np.flatnonzero(x[live] < time[slot])
            if len(better):
                # the earliest of several arrivals at a component is written last
                order = better[np.argsort(-x[live[better]], kind="stable")]
                time[slot[order]] = x[live[order]]
                who[slot[order]] = grams[live[order]]
                worst = time.reshape(n, size).max(axis=1)
    return who.reshape(n, size)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) int64 bucket keys; a band's number is part of its key."""
    out = np.zeros((len(signature), bands), np.uint64)
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    with np.errstate(over="ignore"):
        out += np.arange(1, bands + 1, dtype=np.uint64) * _GOLD
        for j in range(rows):
            out = mix(out * np.uint64(0x100000001B3) + parts[:, :, j])
    return out.view(np.int64)


def probability_jaccard(h1: np.ndarray, a: np.ndarray, h2: np.ndarray, b: np.ndarray) -> float:
    """Exact J_P of two weighted sets given as ascending hashes and positive weights."""
    _, i, j = np.intersect1d(h1, h2, assume_unique=True, return_indices=True)
    if len(i) == 0:
        return 0.0
    a, b = a.astype(np.float64), b.astype(np.float64)
    only_a, only_b = a.sum() - a[i].sum(), b.sum() - b[j].sum()
    a, b = a[i], b[j]
    order = np.argsort(a / b, kind="stable")
    a, b = a[order], b[order]
    # for e of a ratio not below d's the larger term is a_e / a_d, else b_e / b_d
    above = a.sum() - np.cumsum(a) + a
    below = np.cumsum(b) - b
    return float((1.0 / ((above + only_a) / a + (below + only_b) / b)).sum())


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _sketch(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int, rows: int) -> DataFrame:
    """m (digest), d (id), sig (a byte a component) and keys of every row with a text; no key without a word."""
    schema = T.StructType([
        T.StructField("m", T.BinaryType()), T.StructField("d", docs.schema[id_col].dataType), T.StructField("sig", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(2))
            for lo, hi in slices(offsets, 1 << 20):
                words, first = word_hashes(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                text, grams, counts = shingles(words, first, k)
                sig = signatures(text, grams, counts, hi - lo, bands * rows)
                keys = band_keys(sig, bands, rows)
                sizes = np.where(np.diff(first) > 0, bands, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(keys[sizes > 0].ravel()))
                short = pa.array([x.tobytes() for x in mix(sig).astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), short, lists], names=schema.names)

    text = F.col(text_col).cast("string")
    rows_ = docs.select(_digest(text).alias("m"), F.col(id_col).alias("d"), text.alias("t")).where("t is not null")
    return rows_.mapInArrow(run, schema)


def bucket_links(key: np.ndarray, sig: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """(member, leader) rows of the candidates in buckets of ascending ``key``: share of equal components of ``low`` or more; at ``high`` a member is done."""
    members, leaders, live = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.arange(len(key))
    of = np.arange(len(key))  # the leader a member is done with; a leader's own is itself
    while len(live):
        start = np.flatnonzero(np.diff(key[live], prepend=~key[live[0]]))
        lead = np.repeat(live[start], np.diff(start, append=len(live)))
        a, b = live[live != lead], lead[live != lead]
        share = np.concatenate([np.zeros(0), *((sig[a[i : i + 8192]] == sig[b[i : i + 8192]]).mean(axis=1) for i in range(0, len(a), 8192))])
        members.append(a[share >= low])
        leaders.append(b[share >= low])
        of[a[share >= high]] = b[share >= high]
        live = a[share < high]
    if len(key):
        ends = np.append(np.flatnonzero(np.diff(key)) + 1, len(key))
        begins = np.append(0, ends[:-1])
        led = np.add.reduceat(of == np.arange(len(key)), begins)
        # buckets of several leaders of which one at least has done members
        for i in np.flatnonzero((led > 1) & (led < ends - begins)).tolist():
            for a, b in _links_of_done(of[begins[i] : ends[i]] - begins[i], sig[begins[i] : ends[i]], low, high):
                members.append(a + begins[i])
                leaders.append(b + begins[i])
    return np.concatenate(members), np.concatenate(leaders)


def _links_of_done(of: np.ndarray, sig: np.ndarray, low: float, high: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates between the done members of each leader of one bucket and the members of later leaders, but for those joined by a share of ``high``."""
    joined = of.copy()
    done = np.flatnonzero(of != np.arange(len(of)))
    for leader in np.unique(of[done]).tolist():
        mine = done[of[done] == leader]
        others = np.flatnonzero((of > leader) & (joined != joined[leader]))
        step = max(1, 8192 // len(mine))
        for at in range(0, len(others), step):
            part = others[at : at + step]
            part = part[joined[part] != joined[leader]]
            if len(part) == 0:
                continue
            share = np.concatenate([(sig[part][:, None] == sig[mine[j : j + 8192]]).mean(axis=2) for j in range(0, len(mine), 8192)], axis=1)
            best = share.max(axis=1)
            sure = np.flatnonzero(best >= high)
            yield part[sure], mine[share[sure].argmax(axis=1)]
            row, column = np.nonzero((share >= low) & (best < high)[:, None])
            yield part[row], mine[column]
            joined[np.isin(joined, joined[part[sure]])] = joined[leader]


def _blocked(sized: DataFrame, block: int) -> DataFrame:
    """(key, m) of buckets (key, m, n): those of n over ``block`` become one bucket for every two of their blocks."""
    blocks = F.ceil(F.col("n") / block)
    mine = F.pmod(F.xxhash64("m"), blocks)
    others = F.filter(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: j != mine)
    pairs = F.transform(others, lambda j: F.xxhash64("key", F.least(mine, j), F.greatest(mine, j)))
    return sized.select(F.explode(F.when(blocks > 1, pairs).otherwise(F.array("key"))).alias("key"), "m")


def _candidates(crowded: DataFrame, signed: DataFrame, size: int, threshold: float) -> DataFrame:
    """(m, l) of the members of each bucket (key, m) that a signature's estimate leaves in question, each pair once."""
    deviation = (threshold * (1 - threshold) / size) ** 0.5
    low, high = threshold - 4 * deviation, threshold + 3 * deviation

    def linked(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks()
        sig = np.frombuffer(b"".join(whole.column(2).to_pylist()), np.uint8).reshape(-1, size)
        a, b = bucket_links(whole.column(0).to_numpy(), sig, low, high)
        m = whole.column(1).combine_chunks()
        m = m.chunk(0) if isinstance(m, pa.ChunkedArray) else m
        return pa.RecordBatch.from_arrays([m.take(pa.array(a)), m.take(pa.array(b))], names=["m", "l"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # ends within a bucket
        for batch in batches:
            key = batch.column(0).to_numpy()
            if len(key) == 0:
                continue
            cut = int(np.searchsorted(key, key[-1], side="left"))
            if held and (cut or held[-1].column(0)[-1].as_py() != int(key[0])):
                yield linked([*held, batch.slice(0, cut)])
                held = []
            elif cut:
                yield linked([batch.slice(0, cut)])
            held.append(batch.slice(cut))
        if held:
            yield linked(held)

    rows = crowded.join(signed, "m").select("key", "m", "sig").repartition("key").sortWithinPartitions("key", "m")
    return rows.mapInArrow(run, "m binary, l binary").distinct()


_SETS = "m binary, h binary, c binary"


def _shingle_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """m with the sorted shingle hashes and counts (as bytes) of each text among ``nodes``; one row a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            for lo, hi in slices(offsets):
                words, first = word_hashes(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                text, grams, counts = shingles(words, first, k)
                cut = np.searchsorted(text, np.arange(hi - lo + 1)).tolist()
                counts = counts.astype(np.uint32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array([grams[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                    pa.array([counts[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                ], names=["m", "h", "c"])

    # a text is taken from the row of its smallest id; <= and not = keeps the rows hashed by the digest alone,
    # so that of wholly repeated rows all but one go without another exchange
    text = F.col(text_col).cast("string")
    rows = docs.select(_digest(text).alias("m"), F.col(id_col).alias("d"), text.alias("t"))
    wanted = nodes.select(F.col("m").alias("w"), F.col("d").alias("e"))
    joined = rows.join(wanted, (F.col("m") == F.col("w")) & ((F.col("d") <= F.col("e")) | F.col("e").isNull()))
    return joined.groupBy("m").agg(F.first("t").alias("t")).mapInArrow(run, _SETS)


def _verified(edges: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The edges (m, l) whose shingle sets have J_P of ``threshold`` or more, with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, c1, h2, c2 = (batch.column(i) for i in (2, 3, 4, 5))
            near = [
                probability_jaccard(*(np.frombuffer(x[i].as_buffer(), t) for x, t in ((h1, np.uint64), (c1, np.uint32), (h2, np.uint64), (c2, np.uint32))))
                for i in range(batch.num_rows)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.float64())], names=["m", "l", "similarity"])

    leader = sets.select(F.col("m").alias("l"), F.col("h").alias("lh"), F.col("c").alias("lc"))
    both = edges.join(sets, "m").join(leader, "l").select("m", "l", "h", "c", "lh", "lc")
    return both.mapInArrow(run, "m binary, l binary, similarity double").where(F.col("similarity") >= threshold)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node of the undirected edges (u, v); root is the component's smallest node.

    Alternating large-star and small-star steps: each is one grouping by node, and the
    number of rounds grows with the logarithm of the size of a component.
    """

    def large(e: DataFrame) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = F.least("u", F.min("v").over(Window.partitionBy("u")))
        return both.select(F.col("v").alias("a"), least.alias("b"), "u").where("a > u and a != b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = F.min("v").over(Window.partitionBy("u"))
        pairs = down.select("u", "v", least.alias("b"))
        links = pairs.where("v != b").select(F.col("v").alias("u"), F.col("b").alias("v"))
        return links.union(pairs.select("u", F.col("b").alias("v"))).distinct()

    state = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before = None
    while True:
        state = materialise(small(large(state)), name)
        # links only move to smaller nodes: equal digests of the links mean that a round changed nothing
        now = tuple(state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = state.select("v").distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))


def near_links(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """(rows, links): m and d of every row with a text; (m, l, similarity) of the verified links between distinct texts."""
    sketch = materialise(_sketch(docs, id_col, text_col, k, bands, rows), "sketch")
    texts = sketch.groupBy("m").agg(F.first("keys").alias("keys"))
    buckets = texts.select("m", F.explode("keys").alias("key"))
    # lone members of a bucket leave it; sizes are counted before the exchange and written, so that a hot key's side of the join can be split
    sizes = materialise(buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    crowded = materialise(_blocked(buckets.join(sizes, "key"), block), "buckets")
    signed = sketch.select("m", "sig").join(crowded.select("m").distinct(), "m", "left_semi").dropDuplicates(["m"])
    edges = materialise(_candidates(crowded, signed, bands * rows, threshold), "candidates")
    nodes = edges.select("m").union(edges.select("l")).distinct()
    wanted = sketch.select("m", "d").join(nodes, "m", "left_semi").groupBy("m").agg(F.min("d").alias("d"))
    sets = materialise(_shingle_sets(docs, wanted, id_col, text_col, k), "sets")
    return sketch.select("m", "d"), materialise(_verified(edges, sets, threshold), "links")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): m and d of every row with a text; for each text of a group of several rows m, and the survivor's id ``keep`` and digest ``root``."""
    rows, links = near_links(docs, id_col, text_col, **parameters)
    of = components(links.select(F.col("m").alias("u"), F.col("l").alias("v")))
    texts = rows.groupBy("m").agg(F.min("d").alias("d"), F.count("*").alias("n"))
    grouped = texts.join(of.withColumnRenamed("node", "m"), "m", "left").withColumn("root", F.coalesce("root", "m"))
    by = Window.partitionBy("root")
    best = F.min(F.struct(F.col("d").isNull().alias("z"), "d", "m")).over(by)
    groups = grouped.withColumn("best", best).withColumn("size", F.sum("n").over(by)).where("size > 1")
    return rows, groups.select("m", F.col("best.d").alias("keep"), F.col("best.m").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """(id, duplicate_of) of every row that does not survive; ``duplicate_of`` is the surviving id of its group."""
    rows, groups = duplicate_groups(docs, id_col, text_col, **parameters)
    member = rows.join(groups, "m").withColumn("first", F.col("d").eqNullSafe(F.col("keep")) & (F.col("m") == F.col("root")))
    # of wholly repeated survivors one stays
    nth = F.row_number().over(Window.partitionBy("m", "d").orderBy("keep"))
    again = member.where("first").withColumn("nth", nth).where("nth > 1").drop("nth")
    return member.where("not first").union(again).select(F.col("d").alias(id_col), F.col("keep").alias(*free_names(id_col, "duplicate_of")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows of ``docs``, all columns, without those that ``near_duplicates`` names: one row of each group stays."""
    _, groups = duplicate_groups(docs, id_col, text_col, **parameters)
    gone = groups.select(F.col("m").alias("__tessera_m"), F.col("keep").alias("__tessera_keep"), F.col("root").alias("__tessera_root"))
    keyed = docs.withColumn("__tessera_md5", _digest(F.col(text_col).cast("string")))
    joined = keyed.join(gone, F.col("__tessera_md5") == F.col("__tessera_m"), "left")
    first = F.col(id_col).eqNullSafe(F.col("__tessera_keep")) & (F.col("__tessera_md5") == F.col("__tessera_root"))
    alone = joined.where("__tessera_m is null").select(*docs.columns)
    kept = joined.where(F.col("__tessera_m").isNotNull() & first).dropDuplicates(["__tessera_md5", id_col]).select(*docs.columns)
    return alone.union(kept)
