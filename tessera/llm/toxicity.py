"""Toxicity by a string-kernel support vector machine.

The kernel of two units (a word, or single letters spelt in a row) sums over all
subsequences of three letters they share, each occurrence weighted by lambda to the power
of the stretch it spans, so inserted characters and gaps lower similarity only gradually; it
is normalised to 1 for a unit with itself.

The machine learns from labelled sentences as bags of units, of which one at least makes a
toxic one toxic and none a clean one. Telling units, over-represented in toxic bags beyond
chance, begin as the toxic examples (near copies of a text count once); clean examples are
units of clean bags, and in each of ``ROUNDS`` rounds the unit of every clean bag that
comes nearest to being toxic joins them. Landmarks are chosen among the examples, the
Nystroem map K(x, L) K(L, L)^(-1/2) gives the features, and a linear hinge-loss machine is
fitted on them. As the kernel is an inner product of subsequence vectors, landmarks and
weights fold into one table of the LETTERS^3 triples, and scoring a unit is a sum of table
entries over its triples.

A document is toxic if its highest unit is above a threshold that best separates the
labelled documents. Training reads at most ``train_rows`` labelled documents of each
class, chosen by a hash of the row (a classifier's bounded sample), and begins with at most ``CLEAN`` clean units; every unit of
every document is scored.

Defined results: a null or empty text has no unit and is not toxic; a very long text is read
to its end, a word of more than ``LONGEST`` letters in overlapping stretches of that many;
of units of equal score the alphabetically first is named; without toxic or clean labels
nothing is toxic; null labels are ignored; repeated rows and null ids are scored like any
row; an empty table gives an empty result; other columns are not read, and where the id
column is called score or unit, that column of the result has an underscore appended.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import free_names, mix

DECAY, LONGEST, LETTERS = 0.75, 12, 48
#: Clean units that training begins with at most, and rounds in which others join.
CLEAN, ROUNDS = 3000, 3
_LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
#: Tokens whose scores a worker remembers; beyond it starts afresh. Changes speed only.
REMEMBERED = 400_000


def fold(token: str) -> str:
    """The letters of a token, lower-cased; digits and signs that stand for letters inside a word become them, others go.

    Accents stay: a word with one is another word, and the kernel bridges a single differing letter.
    """
    token = token.lower()
    if token.isascii() and token.isalpha():
        return token
    if not token.isascii():
        token = unicodedata.normalize("NFC", token)
    if not any(map(str.isalpha, token)):
        return ""
    inner = token.strip("!.,;:?\"'()")
    return "".join(c if c.isalpha() else _LOOKALIKES.get(c, "") for c in inner)


def spelt(tokens: list[str]) -> list[str]:
    """Single characters that stand in a row, three or more, as one token each."""
    sizes = list(map(len, tokens))
    if sizes.count(1) < 3:
        return []
    out, run = [], []
    for token, size in zip([*tokens, ""], [*sizes, 0], strict=True):
        if size == 1:
            run.append(token)
        else:
            if len(run) >= 3:
                out.append("".join(run))
            run = []
    return out


def tokens_of(text: str | None) -> list[str]:
    found = text.split() if text else []
    return found + spelt(found)


def units(text: str | None) -> list[str]:
    """Folded words of three letters or more, and spelt-out runs of single letters."""
    return [u for u in map(fold, tokens_of(text)) if len(u) >= 3]


def windows(unit: str) -> list[str]:
    """A unit longer than LONGEST as overlapping stretches of that length."""
    if len(unit) <= LONGEST:
        return [unit]
    return [unit[i : i + LONGEST] for i in range(0, len(unit) - LONGEST, LONGEST // 2)] + [unit[-LONGEST:]]


_TRIPLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _TRIPLES:
        at = np.array(list(combinations(range(n), 3)), np.int64)
        _TRIPLES[n] = at, DECAY ** (at[:, 2] - at[:, 0] + 1.0)
    return _TRIPLES[n]


def _codes(stretches: list[str]) -> np.ndarray:
    """Letter numbers of equally long stretches: a-z 1 to 26, other letters by their code 27 and up."""
    text = np.frombuffer("".join(stretches).encode("utf-32-le"), np.uint32).reshape(len(stretches), -1)
    return np.where((text >= 97) & (text <= 122), text.astype(np.int64) - 96, 27 + text.astype(np.int64) % (LETTERS - 27))


def _triple_numbers(codes: np.ndarray) -> np.ndarray:
    at, _ = _triples(codes.shape[1])
    codes = codes.astype(np.int32)
    return (codes[:, at[:, 0]] * LETTERS + codes[:, at[:, 1]]) * LETTERS + codes[:, at[:, 2]]


def vectors(stretches: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised subsequence vectors of equally long stretches as (row, triple, value), triples not yet summed."""
    codes = _codes(stretches)
    triple, weight = _triple_numbers(codes), _triples(codes.shape[1])[1]
    norm = np.sqrt(_self_kernel(codes))
    return triple, weight, norm


def _self_kernel(codes: np.ndarray) -> np.ndarray:
    """The kernel of each stretch with itself, by the recursion over prefix pairs, all stretches at once."""
    rows, n = codes.shape
    same = codes.T[:, None, :] == codes.T[None, :, :]
    # inner[a][b]: matches of the first a and b letters so far, each weighted to the ends of the prefixes
    inner = np.ones((n + 1, n + 1, rows))
    for _ in range(2):
        new = np.zeros((n + 1, n + 1, rows))
        for a in range(1, n + 1):
            along = np.zeros(rows)
            for b in range(1, n + 1):
                along = DECAY * along + np.where(same[a - 1, b - 1], DECAY**2 * inner[a - 1, b - 1], 0.0)
                new[a, b] = DECAY * new[a - 1, b] + along
        inner = new
    return (DECAY**2 * np.where(same, inner[:-1, :-1], 0.0)).sum(axis=(0, 1))


def dense(words: list[str]) -> np.ndarray:
    """Normalised subsequence vectors as rows of a matrix."""
    out = np.zeros((len(words), LETTERS**3), np.float32)
    for i, word in enumerate(words):
        triple, weight, norm = vectors([word])
        np.add.at(out[i], triple[0], weight / norm[0])
    return out


def kernel(words: list[str], basis: np.ndarray) -> np.ndarray:
    """Kernel of each word with each row of ``basis`` (triples, landmarks), whatever their lengths."""
    out = np.zeros((len(words), basis.shape[1]))
    for length in sorted({len(w) for w in words}):
        at = [i for i, w in enumerate(words) if len(w) == length]
        for lo in range(0, len(at), 64):
            triple, weight, norm = vectors([words[i] for i in at[lo : lo + 64]])
            out[at[lo : lo + 64]] = np.matmul(weight.astype(np.float32), basis[triple]) / norm[:, None]
    return out


class Stretches:
    """The stretches of units, by length, with their norms: what scoring needs of them whatever the machine."""

    def __init__(self, found: list[str]) -> None:
        self.units = len(found)
        by_length: dict[int, tuple[list[int], list[str]]] = {}
        for i, unit in enumerate(found):
            for s in windows(unit):
                owner, stretches = by_length.setdefault(len(s), ([], []))
                owner.append(i)
                stretches.append(s)
        self.groups = []
        for owner, stretches in by_length.values():
            codes = _codes(stretches).astype(np.int8)
            norm = np.concatenate([np.sqrt(_self_kernel(codes[lo : lo + 2048])) for lo in range(0, len(codes), 2048)])
            self.groups.append((np.array(owner), codes, norm))

    def margins(self, table: np.ndarray, bias: float) -> np.ndarray:
        """The highest margin of each unit's stretches."""
        out = np.full(self.units, -np.inf)
        for owner, codes, norm in self.groups:
            _, weight = _triples(codes.shape[1])
            for lo in range(0, len(codes), 2048):
                np.maximum.at(out, owner[lo : lo + 2048], (table[_triple_numbers(codes[lo : lo + 2048])] @ weight) / norm[lo : lo + 2048] + bias)
        return out


class Machine:
    """A table of triples, a bias, and the document threshold; ``support``: the landmarks and their coefficients, which the table holds folded."""

    def __init__(self, table: np.ndarray, bias: float, threshold: float = 0.0, support: tuple[list[str], np.ndarray] | None = None) -> None:
        self.table, self.bias, self.threshold, self.support = table, bias, threshold, support

    def margins(self, found: list[str]) -> np.ndarray:
        return Stretches(found).margins(self.table, self.bias)


def copies(bags: list[set[str]], hashes: int = 8, share: float = 0.8) -> list[int]:
    """For each bag the number of the first one that it is a near copy of, or its own: by minimum hashes, and the share of units in common."""
    first: dict[tuple[int, int], int] = {}
    out = []
    for i, bag in enumerate(bags):
        found = i
        if bag:
            codes = np.array([hash_of(u) for u in bag], np.uint64)
            for j in range(hashes):
                low = int(mix(codes ^ np.uint64(j * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).min())
                other = first.setdefault((j, low), i)
                if other != i and len(bag & bags[other]) >= share * len(bag | bags[other]):
                    found = min(found, out[other])
        out.append(found)
    return out


def train(documents: list[tuple[str | None, int]], landmarks: int = 160, passes: int = 15) -> Machine | None:
    """The machine from (text, toxic) pairs; None unless both classes have a telling unit."""
    seen = [set(units(t)) for t, _ in documents]
    label = np.array([bool(y) for _, y in documents])
    n_toxic = int(label.sum())
    n_clean = len(documents) - n_toxic
    if not n_toxic or not n_clean:
        return None
    # one of each group of near copies, in either class
    alone = [[i for i, first in zip(of, copies([seen[i] for i in of]), strict=True) if of[first] == i] for of in (np.flatnonzero(label).tolist(), np.flatnonzero(~label).tolist())]
    toxic, clean = (Counter(u for i in of for u in seen[i]) for of in alone)
    # a telling unit is in more toxic documents than chance allows for any of all the units tried
    share, bound = len(alone[0]) / len(alone[0] + alone[1]), np.log(0.01 / max(1, len(toxic)))
    bad = sorted((u for u, c in toxic.items() if c >= 2 and _chance(c, c + clean[u], share) < bound), key=lambda u: (-toxic[u], u))
    told = set(bad)
    every = sorted({u for own in seen for u in own})
    innocent = sorted({u for own, y in zip(seen, label, strict=True) if not y for u in own} - told)
    common = sorted(innocent, key=lambda u: (-clean[u], u))[: CLEAN // 3]
    good = set(common) | set(sorted(set(innocent) - set(common), key=hash_of)[: CLEAN - len(common)])
    if not bad or not good:
        return None
    machine, stretches = _machine(bad, sorted(good), landmarks, passes), Stretches(every)
    for _ in range(ROUNDS):
        margin = dict(zip(every, stretches.margins(machine.table, machine.bias).tolist(), strict=True))
        good |= {max(own, key=lambda u: (margin[u], u)) for own in ((bag - told) for bag, y in zip(seen, label, strict=True) if not y) if own}
        machine = _machine(bad, sorted(good), landmarks, passes)
    # the threshold with the fewest wrong labelled documents; a quarter up the widest of the best gaps, as spelt-around
    # insults score below plain ones
    margin = dict(zip(every, stretches.margins(machine.table, machine.bias).tolist(), strict=True))
    score = np.array([max((margin[u] for u in own), default=-np.inf) for own in seen])
    edges = np.unique(score[np.isfinite(score)])
    middles = np.concatenate([(3 * edges[:-1] + edges[1:]) / 4, edges[-1:] + 1]) if len(edges) else np.array([1.0])
    # scores of either class below each middle
    below = [np.searchsorted(np.sort(score[of]), middles, side="left") for of in (label, ~label)]
    wrong = below[0] / n_toxic + 1 - below[1] / n_clean
    gap = np.append(np.diff(edges), 0.0) if len(edges) else np.zeros(1)
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    machine.threshold = float(middles[best[np.argmax(gap[best])]])
    return machine


def _chance(c: int, n: int, share: float) -> float:
    """Upper bound of the logarithm of the chance of ``c`` or more of ``n`` toxic (Chernoff); 0 where that is no more than expected."""
    q = c / n
    if q <= share:
        return 0.0
    return -n * (q * math.log(q / share) + ((1 - q) * math.log((1 - q) / (1 - share)) if q < 1 else 0.0))


def _machine(bad: list[str], good: list[str], landmarks: int, rounds: int) -> Machine:
    """Nystroem features on landmarks of both classes and a linear hinge-loss machine by dual coordinate descent."""
    bad, good = (list(dict.fromkeys(w for u in side for w in windows(u))) for side in (bad, sorted(good, key=hash_of)))
    words = bad + good
    target = np.array([1.0] * len(bad) + [-1.0] * len(good))
    half = landmarks // 2
    marks = bad[: 2 * half] + good[:half]
    basis = np.ascontiguousarray(dense(marks).T)
    values, axes = np.linalg.eigh((basis.T @ basis).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = axes[:, keep] / np.sqrt(values[keep])
    x = kernel(words, basis) @ root
    x = np.column_stack([x, np.ones(len(x))])
    cost = np.where(target > 0, len(words) / (2 * len(bad)), len(words) / (2 * len(good)))
    alpha, w, norms = np.zeros(len(x)), np.zeros(x.shape[1]), (x**2).sum(axis=1)
    order = np.arange(len(x))
    generator = np.random.default_rng(7)
    for _ in range(rounds):
        generator.shuffle(order)
        for i in order:
            new = min(max(alpha[i] - (target[i] * (w @ x[i]) - 1) / norms[i], 0.0), 5.0 * cost[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * target[i] * x[i]
                alpha[i] = new
    return Machine((basis.astype(np.float64) @ (root @ w[:-1])).astype(np.float32), float(w[-1]), support=(marks, root @ w[:-1]))


def hash_of(word: str) -> int:
    """A stable pseudo-random number of a word."""
    h = 1469598103934665603
    for b in word.encode():
        h = ((h ^ b) * 1099511628211) & (2**64 - 1)
    return h


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", train_rows: int = 2500) -> Machine | None:
    """The machine, from at most ``train_rows`` labelled documents of each class."""
    known = labels.where(f"`{id_col}` is not null and `{toxic_col}` in (0, 1)").select(F.col(id_col).alias("i"), F.col(toxic_col).cast("int").alias("y"))
    chosen = None
    for y in (0, 1):
        part = known.where(f"y = {y}").distinct().orderBy(F.xxhash64("i"), "i").limit(train_rows)
        chosen = part if chosen is None else chosen.union(part)
    # twice train_rows narrow rows at most, so this side is small whatever the tables' sizes
    rows = docs.select(F.col(id_col).alias("d"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(chosen), F.col("d") == F.col("i"))
    return train(sorted(((r["t"], r["y"]) for r in rows.select("t", "y").collect()), key=lambda x: (x[1], x[0] or "")))


def toxic(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", train_rows: int = 2500
) -> DataFrame:
    """id, score (the highest unit's margin above the threshold) and unit of each toxic document. Row-local after training."""
    return found_by(fit(docs, labels, id_col, text_col, toxic_col, train_rows), docs, id_col, text_col)


def found_by(machine: Machine | None, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``toxic`` gives, by a trained machine."""
    score_col, unit_col = free_names(id_col, "score", "unit")
    schema = T.StructType([docs.schema[id_col], T.StructField(score_col, T.DoubleType()), T.StructField(unit_col, T.StringType())])
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string"))
    if machine is None:
        return docs.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.bpe import _small

        known: dict[str, float] = {}
        for batch in _small(batches, 1, 1 << 20):
            own = [tokens_of(t) for t in batch.column(1).to_pylist()]
            if len(known) > REMEMBERED:
                known.clear()
            new = list({u for row in own for u in row if u not in known})
            folded = [fold(u) for u in new]
            fit = [u for u in folded if len(u) >= 3]
            found = dict(zip(fit, machine.margins(fit).tolist(), strict=True))
            known.update((u, found.get(f, -np.inf)) for u, f in zip(new, folded, strict=True))
            at, score, unit = [], [], []
            for i, row in enumerate(own):
                best = max(map(known.__getitem__, row), default=-np.inf)
                if best >= machine.threshold:
                    at.append(i)
                    score.append(round(best - machine.threshold, 6))
                    unit.append(min(fold(u) for u in row if known[u] == best))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(score, pa.float64()), pa.array(unit, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
