"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Votes are
counted by pattern over all documents, and expectation-maximisation on the counts
estimates each labeller's accuracy (its chances of each vote given the true class) and the
share of good documents; a pattern's posterior is the soft label of its documents. A
linear scorer over hashed features - byte trigrams of the whole text and the labellers'
measures in steps - is then trained on the posteriors of a bounded sample
(``train_rows``) by gradient descent, and scores every document from 0 to 1.

Memory for the votes is bounded by the number of patterns (three to the number of
labellers), not by the corpus. The sample is taken by a hash of id and text, each pair of them once. Measures are
made of whole batches in arrays (``measures_of``); ``measures`` says of one text what they are.

Defined results: a null text and one without a word score 0 and are rejected (there is
nothing to train on); a very long text is measured to its end; repeated rows and null ids are scored like any row, equal
texts alike; a score equal to the threshold is kept; an empty table gives an empty result; other columns are
carried along by ``accepted``, whatever their names, and where the id column is called score, that
column of ``accepted_scores`` has an underscore appended.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import free_names, mix, slices, text_buffer

DIMENSIONS = 1 << 15
FUNCTION_WORDS = frozenset(
    "the of and to in is it that was for on are as with be at by this from or an a de la le les des et en un une du que qui dans pour pas sur au est par "
    "der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch es el los las por con no se lo su una del al y".split()
)
_SYMBOLS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"()-?_=/@")
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))

#: name, bad from, good until: a measure at or above the first votes bad, at or below the second good, else nothing.
#: That a text lacks one defect says nothing of others, so those labellers only ever vote bad (NEVER).
NEVER = -1.0
LABELLERS = (
    ("capitals", 0.35, NEVER),
    ("symbols", 0.03, NEVER),
    ("marks", 0.08, NEVER),
    ("repeats", 0.2, 0.05),
    ("sameness", 0.6, 0.4),
    ("commonest", 0.12, NEVER),
    ("copied_lines", 0.35, NEVER),
    ("glued", 0.3, NEVER),
    ("no_function_words", 0.98, 0.93),
)


def measures(text: str | None) -> tuple[float, ...] | None:
    """A text's measures, one a labeller, higher is worse; None without a word."""
    words = (text or "").split()
    n = len(words)
    if n == 0:
        return None
    data = text.encode()
    upper, lower = len(data) - len(data.translate(None, _UPPER)), len(data) - len(data.translate(None, _LOWER))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    distinct = set(words)
    lines = text.split("\n")
    glued = sum(1 for w in words if len(w) > 1 and not w[-1].isalnum() and not w[-2].isalnum()) / n
    return (
        upper / max(1, upper + lower) if upper + lower >= 40 else 0.0,
        symbols / len(data),
        sum(1 for w in words if not any(map(str.isalnum, w))) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        (1 - len(distinct) / n) if n >= 20 else 0.0,
        max(Counter(words).values()) / n if n >= 20 else 0.0,
        1 - len(set(lines)) / len(lines) if len(lines) >= 3 else 0.0,
        glued,
        1 - sum(1 for w in words if w in FUNCTION_WORDS) / n if n >= 20 else 0.9,
    )


_SPACE, _ALNUM = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_ALNUM[[b for b in range(128) if chr(b).isalnum()]] = True
_IS_UPPER, _IS_LOWER, _IS_SYMBOL = (np.isin(np.arange(256), list(of)) for of in (_UPPER, _LOWER, _SYMBOLS))
#: An odd factor and its inverse modulo 2^64: a range's hash is its share of one running sum, whatever its place.
_FACTOR = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The first ``n`` powers, at least, of the factor and of its inverse."""
    if len(_POWERS[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for i, base in enumerate((_FACTOR, _INVERSE)):
            _POWERS[i] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, base))])
    return _POWERS


def _characters(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(white space by byte, letter or digit by byte, number of a byte's character, first bytes of characters) of UTF-8."""
    space, alnum = _SPACE[raw], _ALNUM[raw]
    lead = (raw & 0xC0) != 0x80
    first = np.flatnonzero(lead)
    of = np.cumsum(lead) - 1
    wide = np.flatnonzero(raw[first] >= 0xC0)
    if len(wide):
        at = first[wide]
        size = np.where(raw[at] >= 0xF0, 4, np.where(raw[at] >= 0xE0, 3, 2))
        code = raw[at] & np.array([0, 0, 0x1F, 0x0F, 0x07])[size]
        for j in (1, 2, 3):
            more = size > j
            code[more] = code[more] << 6 | raw[at[more] + j] & 0x3F
        kinds, which = np.unique(code, return_inverse=True)
        letters = np.zeros(len(first), bool)
        blanks = np.zeros(len(first), bool)
        letters[wide] = np.array([chr(c).isalnum() for c in kinds.tolist()])[which]
        blanks[wide] = np.array([chr(c).isspace() for c in kinds.tolist()])[which]
        beyond = raw >= 0x80
        alnum[beyond] = letters[of[beyond]]
        space[beyond] = blanks[of[beyond]]
    return space, alnum, of, first


def _sums(raw: np.ndarray) -> np.ndarray:
    """Running sum of a buffer's bytes times powers of the factor, from 0."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(len(raw))[0][: len(raw)], out=out[1:])
    return out


def _pieces(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges."""
    return mix((sums[end] - sums[start]) * _powers(len(sums))[1][start])


def _repeated(n: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes, occurrences of the commonest) of owners of ``n`` codes each, in a row."""
    count = len(n)
    if len(code) == 0:
        return np.zeros(count, np.int64), np.zeros(count, np.int64)
    owner = np.repeat(np.arange(count, dtype=np.uint64), n)
    key = np.sort(owner << np.uint64(40) | code >> np.uint64(24))
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    of = (key[at] >> np.uint64(40)).astype(np.int64)
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    most = np.zeros(count, np.int64)
    most[of[first]] = np.maximum.reduceat(np.diff(at, append=len(key)), first)
    return np.bincount(of, minlength=count), most


def measures_of(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, labellers): what ``measures`` gives of each of consecutive texts; rows of nan where it gives none."""
    count = len(offsets) - 1
    out = np.full((count, len(LABELLERS)), np.nan)
    if len(raw) == 0:
        return out
    lo, hi = offsets[:-1], offsets[1:]
    begin = np.zeros(len(raw) + 1, bool)
    begin[offsets] = True

    full = np.flatnonzero(hi > lo)

    def per_text(mask: np.ndarray) -> np.ndarray:
        counts = np.zeros(count, np.int64)
        counts[full] = np.add.reduceat(mask, lo[full], dtype=np.int64)
        return counts

    space, alnum, char_of, char_at = _characters(raw)
    ink = ~space
    start = np.flatnonzero(ink & (np.append(True, space[:-1]) | begin[:-1]))
    end = np.flatnonzero(ink & (np.append(space[1:], True) | begin[1:])) + 1
    n = np.diff(np.searchsorted(start, offsets))
    owner = np.repeat(np.arange(count), n)
    sums = _sums(raw)
    code = _pieces(sums, start, end)
    same = (code[1:] == code[:-1]) & (owner[1:] == owner[:-1])
    distinct, most = _repeated(n, code)
    mute = np.add.reduceat(alnum, start, dtype=np.int64) == 0 if len(start) else np.zeros(0, bool)
    last = char_of[end - 1]
    before = char_at[np.maximum(last - 1, 0)]
    glued = ~alnum[end - 1] & (before >= start) & (last > 0) & ~alnum[before]
    # a line of any number of bytes; empty ones share a hash
    feed = raw == 10
    lines = per_text(feed) + 1
    feeds = np.flatnonzero(feed)
    line_start = np.sort(np.concatenate([lo, feeds + 1]))
    line_text = np.repeat(np.arange(count), lines)
    line_end = np.append(line_start[1:], len(raw))
    # a line ends before its feed, and at the end of its text
    line_end = np.where(line_end > line_start, np.minimum(line_end, hi[line_text]), line_start)
    closed = (line_end > line_start) & feed[np.maximum(line_end - 1, 0)]
    line_end = line_end - closed
    lines_distinct, _ = _repeated(lines, _pieces(sums, line_start, np.maximum(line_end, line_start)))

    some = n > 0
    words, size = np.maximum(n, 1), np.maximum(hi - lo, 1)
    upper, lower = per_text(_IS_UPPER[raw]), per_text(_IS_LOWER[raw])
    enough = n >= 20
    which = _FUNCTION_AT[(code & np.uint64(0xFFFF)).astype(np.int64)]
    told = _FUNCTION_CODES[which] == code
    by_word = lambda mask: np.bincount(owner[: len(mask)], mask, minlength=count) / words
    found = (
        np.where(upper + lower >= 40, upper / np.maximum(1, upper + lower), 0.0), per_text(_IS_SYMBOL[raw]) / size, by_word(mute), by_word(same),
        np.where(enough, 1 - distinct / words, 0.0), np.where(enough, most / words, 0.0), np.where(lines >= 3, 1 - lines_distinct / lines, 0.0), by_word(glued),
        np.where(enough, 1 - by_word(told), 0.9),
    )
    out[some] = np.stack(found, axis=1)[some]
    return out


def _codes_of(words: list[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    ends = np.cumsum([len(x) for x in data])
    return _pieces(_sums(np.frombuffer(b"".join(data), np.uint8)), np.append(0, ends[:-1]), ends)


#: Hashes of the function words, each at the place that its last two bytes name.
_FUNCTION_CODES = _codes_of(sorted(FUNCTION_WORDS))
_FUNCTION_AT = np.zeros(1 << 16, np.int64)
_FUNCTION_AT[(_FUNCTION_CODES & np.uint64(0xFFFF)).astype(np.int64)] = np.arange(len(_FUNCTION_CODES))
if len(set((_FUNCTION_CODES & np.uint64(0xFFFF)).tolist())) < len(_FUNCTION_CODES):
    raise AssertionError("two function words share a place")
_BAD, _GOOD = (np.array([x[i] for x in LABELLERS]) for i in (1, 2))


def votes(values: np.ndarray) -> np.ndarray:
    """0 (abstains), 1 (bad) or 2 (good) for measures by text and labeller; all bad where there are none."""
    return np.where(np.isnan(values) | (values >= _BAD), 1, np.where(values <= _GOOD, 2, 0))


def patterns(values: np.ndarray) -> np.ndarray:
    """A number for each text's votes; ``pattern_name`` spells it."""
    return votes(values) @ 3 ** np.arange(len(LABELLERS))


def pattern_name(number: int) -> str:
    return "".join("abg"[number // 3**i % 3] for i in range(len(LABELLERS)))


def vote_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(pattern, count) over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(3 ** len(LABELLERS), np.int64)
        for batch in batches:
            raw, offsets = text_buffer(batch.column(0))
            for lo, hi in slices(offsets):
                seen += np.bincount(patterns(measures_of(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])), minlength=len(seen))
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([pattern_name(i) for i in used.tolist()], pa.string()), pa.array(seen[used])], names=["pattern", "count"])

    parts = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "pattern string, count long")
    return parts.groupBy("pattern").agg(F.sum("count").alias("count"))


class LabelModel:
    """Two classes; each labeller's vote is independent given the class. Fitted by expectation-maximisation."""

    def __init__(self, counts: dict[str, int], rounds: int = 200, smoothing: float = 1.0) -> None:
        self.patterns = sorted(counts)
        n = np.array([counts[p] for p in self.patterns], np.float64)
        vote = np.array([["abg".index(c) for c in p] for p in self.patterns]).reshape(len(self.patterns), len(self.patterns[0]) if self.patterns else 0)
        one_hot = np.eye(3)[vote] if len(n) else np.zeros((0, 0, 3))
        # begin with the majority, which also fixes which class is good
        good, bad = (vote == 2).sum(axis=1), (vote == 1).sum(axis=1)
        post = (good + 1.0) / (good + bad + 2.0)
        self.prior, self.chances = 0.5, None
        for _ in range(rounds if len(n) else 0):
            weight = np.stack([n * (1 - post), n * post])
            self.prior = (weight[1].sum() + smoothing) / (n.sum() + 2 * smoothing)
            self.chances = np.einsum("cp,plv->clv", weight, one_hot) + smoothing
            self.chances /= self.chances.sum(axis=2, keepdims=True)
            score = np.einsum("plv,clv->cp", one_hot, np.log(self.chances)) + np.log([[1 - self.prior], [self.prior]])
            new = 1 / (1 + np.exp(np.clip(score[0] - score[1], -700, 700)))
            done = np.abs(new - post).max() < 1e-9
            post = new
            if done:
                break
        self.posterior = dict(zip(self.patterns, post.tolist(), strict=True))

    def accuracies(self) -> dict[str, float]:
        """Each labeller's chance of being right where it votes."""
        if self.chances is None:
            return {}
        bad, good = self.chances
        right = (1 - self.prior) * bad[:, 1] + self.prior * good[:, 2]
        voted = (1 - self.prior) * (bad[:, 1] + bad[:, 2]) + self.prior * (good[:, 1] + good[:, 2])
        return dict(zip((x[0] for x in LABELLERS), (right / voted).tolist(), strict=True))


def measure_slots(values: np.ndarray) -> np.ndarray:
    """Hashed one-hot features of measures by text and labeller: each measure's step on a scale of 16."""
    steps = (16 * np.sqrt(np.clip(values, 0.0, 1.0))).astype(np.uint64)
    codes = np.arange(values.shape[1], dtype=np.uint64) * np.uint64(64) + steps
    return (mix(codes + np.uint64(0x5EED)) % np.uint64(DIMENSIONS)).astype(np.int64)


def trigram_slots(raw: np.ndarray) -> np.ndarray:
    """The slot of each byte trigram of a buffer (two fewer than bytes)."""
    code = raw[:-2].astype(np.uint32) << np.uint32(16) | raw[1:-1].astype(np.uint32) << np.uint32(8) | raw[2:]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of one text: trigram shares and, at equal weight, the measures."""
    values = measures(text)
    if values is None:
        return np.zeros(0, np.int64), np.zeros(0)
    slots = trigram_slots(np.frombuffer(text.encode(), np.uint8)) if len(text.encode()) > 2 else np.zeros(0, np.int64)
    found, n = np.unique(slots, return_counts=True)
    own = measure_slots(np.array([values]))[0]
    return np.concatenate([found.astype(np.int64), own]), np.concatenate([n / max(1, len(slots)), np.full(len(own), 1 / len(own))])


def train(rows: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, rounds: int = 300, rate: float = 20.0, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer for soft targets, classes weighted alike; deterministic."""
    weights, bias = np.zeros(DIMENSIONS), 0.0
    if len(rows) == 0:
        return weights, bias
    sizes = np.array([len(s) for s, _ in rows])
    slots, values = np.concatenate([s for s, _ in rows]), np.concatenate([v for _, v in rows])
    row = np.repeat(np.arange(len(rows)), sizes)
    share = float(np.clip(targets.mean(), 0.02, 0.98))
    importance = targets / (2 * share) + (1 - targets) / (2 * (1 - share))
    importance /= importance.sum()
    speed, speed_bias = np.zeros(DIMENSIONS), 0.0
    for _ in range(rounds):
        z = np.bincount(row, values * weights[slots], minlength=len(rows)) + bias
        error = importance * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - targets)
        gradient = np.bincount(slots, values * error[row], minlength=DIMENSIONS) + decay * weights
        speed, speed_bias = 0.9 * speed + gradient, 0.9 * speed_bias + error.sum()
        weights, bias = weights - rate * speed, bias - speed_bias
    return weights, float(bias)


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights, bias

    def __call__(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        raw, offsets = text_buffer(texts)
        for lo, hi in slices(offsets):
            part, off = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            n = np.diff(off)
            total = np.zeros(hi - lo)
            if len(part) > 2:
                # sums over a text's own trigrams: a running sum, read two bytes before its end
                sums = np.concatenate([[0.0], np.cumsum(self.weights[trigram_slots(part)])])
                total = np.where(n > 2, sums[np.maximum(off[1:] - 2, off[:-1])] - sums[np.minimum(off[:-1], len(sums) - 1)], 0.0)
            values = measures_of(part, off)
            some = ~np.isnan(values[:, 0])
            z = self.bias + total / np.maximum(1, n - 2)
            z[some] += self.weights[measure_slots(values[some])].mean(axis=1)
            out[lo:hi] = np.where(some, 1 / (1 + np.exp(-np.clip(z, -50, 50))), 0.0)
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = 3000) -> tuple[LabelModel, Scorer]:
    """The label model over all documents, and the scorer trained on about ``train_rows`` of them."""
    counts = {r["pattern"]: r["count"] for r in vote_counts(docs, text_col).collect()}  # as many rows as patterns at most
    model = LabelModel(counts)
    total = sum(counts.values())
    text = F.col(text_col).cast("string")
    # a text of several rows of one id is one example, so repeated rows neither crowd the sample nor are all left out
    place = F.xxhash64(F.col(id_col).cast("string"), text, F.lit("quality"))
    share = min(1 << 30, -(-train_rows * (1 << 30) // max(1, total)))
    sample = docs.select(place.alias("h"), text.alias("t")).where(F.pmod("h", F.lit(1 << 30)) < share)
    posterior = model.posterior

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (values := measures(t)) is not None:
                    slots, x = features(t)
                    y = posterior.get(pattern_name(int(patterns(np.array([values]))[0])), model.prior)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([h], pa.int64()), pa.array([slots.astype(np.int32).tobytes()]), pa.array([x.astype(np.float32).tobytes()]), pa.array([y], pa.float64())
                    ], names=["h", "s", "x", "y"])

    # the bound is of memory only: about train_rows are expected
    got = sample.mapInArrow(run, "h long, s binary, x binary, y double").dropDuplicates(["h"]).orderBy("h").limit(2 * train_rows).collect()
    rows = [(np.frombuffer(r["s"], np.int32).astype(np.int64), np.frombuffer(r["x"], np.float32).astype(np.float64)) for r in got]
    return model, Scorer(*train(rows, np.array([r["y"] for r in got])))


def quality(text: Column, scorer: Scorer) -> Column:
    @F.arrow_udf(T.DoubleType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(scorer(texts))

    return run(text.cast("string"))


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, train_rows: int = 3000) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``threshold``. No exchange of the texts."""
    _, scorer = fit(docs, id_col, text_col, train_rows)
    return docs.where(quality(F.col(text_col), scorer) >= threshold)


def accepted_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, train_rows: int = 3000) -> DataFrame:
    """id and score of each document that is kept. In Arrow batches: as a column the scorer would run once for the filter and once for the result."""
    _, scorer = fit(docs, id_col, text_col, train_rows)
    schema = T.StructType([docs.schema[id_col], T.StructField(*free_names(id_col, "score"), T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = scorer(batch.column(1))
            at = np.flatnonzero(scores >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.round(scores[at], 6))], names=schema.names)

    return docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
