"""Language-model scores by Ziv-Merhav cross-parsing against the rest of the corpus.

A document is read as a sequence of words and cut greedily into the longest phrases that
occur in a reference text; a word that the reference lacks is a phrase of its own. With c
phrases in n words and c' phrases in the document's own Lempel-Ziv (1978) parsing,

    cross_entropy    = c log2(n) / n
    relative_entropy = (c log2(n) - c' log2(c')) / n     (bits a word)

The reference of a row is every other row of the corpus; ``good_phrases`` and
``good_entropy`` are the same against every other row labelled good. Nothing is sampled or
left out, a row is never its own reference, and a score depends on the rows alone, not on
how they are partitioned.

One suffix automaton of a reference that grows with the corpus fits no worker, and parts of
it would have to meet every document. So its states are named by hashes of the factors
that lead to them and kept apart by hash: whether a factor is a state is asking if its name
is there. Phrases may be of any length, and asking for every factor of a copied text would
take the square of its length, so a few names stand for all:

* Factors of one to ``START`` = 8 words are all asked for: those of one to three words in a
  first round, longer ones in a second, only where all three words of every run are elsewhere.
* Then one round for each doubling of m = 8, 16, ...: the factors of 2m words, where both
  halves are elsewhere; and of the lengths between only those that a longest match can be. The
  end of the match that begins at a word never falls from one word to the next. It grows only
  where some other row has the match after another word, and it ends only where some row goes
  on otherwise. So it is enough to begin at factors of m words that follow different words (or
  begin a text) and to end with ones that different words follow (or that end a text), which
  copies of a passage lack but for its ends. In a row's own repetition of a short period a
  start asks only for what the start a period before it has not asked.

A round exchanges each batch's distinct factors as sorted byte arrays by bucket and sends back
a byte for each, both compressed: in another row, in how many good rows, after and before different
words. The words beside a factor are told of a round's longest only. What the first round has told
of a batch is kept, four bits a word, and comes back with the second round's answers. After that, only the stretches of text whose every factor of m words is elsewhere go on.
The hash names of a bucket are 40 bits long beyond its number, so that a bucket's size bounds
the share of wrong answers (some 10^-6); the words beside a factor are told apart by 24 bits.
A factor that a third of all rows hold is one entry a batch. Names grow in proportion to the
corpus and the logarithm of its longest repeated passage; beside that a passage of which many
unlike versions exist asks for up to m names a word where each word of it is an end and a start.

Defined results: a null text or one without a word has 0 words and phrases and null
scores; a word is a run of ASCII letters and digits (lower-cased) and non-ASCII
characters; a very long text is one batch of its own at most; repeated rows are each
scored and are each other's reference, whatever their ids; rows with a null id are
reference, but never good; a document is good if any of its label rows says so, null
labels say nothing; without any good row every word is a good phrase; an empty table gives
an empty result; other columns, whatever their names, are not read, and a column of the result
that has the id column's name has an underscore appended.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import discard, free_names, materialise, mix, slices, text_buffer, word_hashes

#: Factors of up to so many words are all asked for.
START = 8
#: Bytes of text in a batch, and of the text or of the names in a bucket, on average.
BATCH_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20
#: In an answer: in another row, the number of good rows up to two, after different words, before different words. In a question the first two, and whether the words beside are told.
ELSEWHERE, GOODS, BEFORE, AFTER, SIDED = 1, 6, 8, 16, 8
_BASE, _GOLD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def cuts(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word of consecutive texts the number of the word after the last that a phrase may hold: its text's end."""
    return np.repeat(first[1:], np.diff(first))


class Factors:
    """Names of the factors of a batch's texts, by length; a factor lies within a text."""

    def __init__(self, words: np.ndarray, first: np.ndarray) -> None:
        self.words, self.first = words, first
        self.end = cuts(words, first)
        self.row = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
        self._name, self.length = mix(words + np.uint64(1)), 1

    def grow(self) -> None:
        """To factors of one word more."""
        self.length += 1
        tail = self.words[self.length - 1 :]
        with np.errstate(over="ignore"):
            self._name = mix(self._name[: len(tail)] * _BASE + tail)

    def at(self) -> np.ndarray:
        """Where a factor of this length begins."""
        n = len(self._name)
        return np.flatnonzero(np.arange(n) + self.length <= self.end[:n])

    def names(self, at: np.ndarray) -> np.ndarray:
        return self._name[at]


def short(factors: Factors) -> tuple[np.ndarray, list[np.ndarray]]:
    """Names of the factors of one to three words, and where they begin, by length."""
    names, places = [], []
    for length in (1, 2, 3):
        if length > 1:
            factors.grow()
        places.append(factors.at())
        names.append(factors.names(places[-1]))
    return np.concatenate(names), places


def longer(factors: Factors, threes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The same of four words and more, where every factor of three words in it is in ``threes`` (by the first word)."""
    names, places, run = [np.zeros(0, np.uint64)], [], threes
    for length in range(4, START + 1):
        factors.grow()
        run = run[:-1] & threes[length - 3 :] if len(run) else run
        n = len(run)
        at = np.flatnonzero(run)
        places.append(at[at + length <= factors.end[:n][at]] if n else np.zeros(0, np.int64))
        if len(places[-1]) == 0:
            break
        names.append(factors.names(places[-1]))
    return np.concatenate(names), places


def ascending(names: np.ndarray) -> np.ndarray:
    """The stable order of names: sorted with their places in the low bits, which takes a fraction of argsort's time, and set right where these bits tell names apart."""
    if len(names) == 0:
        return np.zeros(0, np.int64)
    bits = np.uint64((len(names) - 1).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    keys = (names & ~low) | np.arange(len(names), dtype=np.uint64)
    keys.sort()
    order = (keys & low).astype(np.int64)
    ordered = names[order]
    wrong = np.flatnonzero(ordered[1:] < ordered[:-1])
    if len(wrong):
        top = ordered & ~low
        for x in np.unique(top[wrong]):
            a, b = np.searchsorted(top, x), np.searchsorted(top, x, side="right")
            order[a:b] = order[a:b][np.argsort(names[order[a:b]], kind="stable")]
    return order


class Named:
    """The distinct names of a batch, ascending; ``of`` has what is told of each for every factor that has the name."""

    def __init__(self, names: np.ndarray) -> None:
        self.order = ascending(names)
        ordered = names[self.order]
        self.new = np.ones(len(names), bool)
        self.new[1:] = ordered[1:] != ordered[:-1]
        self.start = np.flatnonzero(self.new)
        self.distinct = ordered[self.start]

    @cached_property
    def group(self) -> np.ndarray:
        return np.cumsum(self.new) - 1

    def of(self, told: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.order), told.dtype)
        out[self.order] = told[self.group]
        return out

    def flags(self, row: np.ndarray, good: np.ndarray) -> np.ndarray:
        """1 for names of several rows, and 2 for each good row up to two; ``row`` as the names, ascending for those of one length."""
        if len(self.order) == 0:
            return np.zeros(0, np.uint8)
        ordered = row[self.order]
        flags = (ordered[self.start] != ordered[np.append(self.start[1:], len(ordered)) - 1]).astype(np.uint8)
        fine = np.flatnonzero(good[ordered] > 0)
        if len(fine):
            group, rows = self.group[fine], ordered[fine]
            start = np.flatnonzero(np.diff(group, prepend=-1))
            end = np.append(start[1:], len(group)) - 1
            flags[group[start]] += (2 + 2 * (rows[start] != rows[end])).astype(np.uint8)
        return flags

    def sides(self, low: int, high: int, *sides: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """``SIDED`` for the names of factors ``low`` to ``high``, and for each of these the code of the word beside it where it is always the same, else 0; ``sides`` as the factors."""
        here = np.flatnonzero((self.order >= low) & (self.order < high))
        group, at = self.group[here], self.order[here] - low
        new = np.ones(len(here), bool)
        new[1:] = group[1:] != group[:-1]
        flags = np.zeros(len(self.distinct), np.uint8)
        flags[group] = SIDED
        return flags, [alike(side[at], new) for side in sides]


def alike(ordered: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Of each group of equal names the value that all have, else 0."""
    out = ordered[new]
    other = np.flatnonzero((ordered[1:] != ordered[:-1]) & ~new[1:]) + 1
    out[np.searchsorted(np.flatnonzero(new), other, side="right") - 1] = 0
    return out


def codes(words: np.ndarray) -> np.ndarray:
    """24 bits of words; 1 stands for none, 0 for different ones."""
    return (mix(words ^ _GOLD) % np.uint64((1 << 24) - 2) + np.uint64(2)).astype(np.uint32)


def packed(distinct: np.ndarray, flags: np.ndarray, bits: int, sides: Sequence[np.ndarray] = ()) -> tuple[list[int], list[bytes], list[bytes]]:
    """(bucket, names, flags) of ascending names: of a name the 40 bits after the bucket's, as steps from one to the next, a plane a byte.

    After the flags come the ``sides``, of the names that are ``SIDED`` only, three planes each.
    """
    if len(distinct) == 0:
        return [], [], []
    bucket = (distinct >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(distinct), np.int64)
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    rest = (distinct << np.uint64(bits)) >> np.uint64(24)
    steps = np.diff(rest, prepend=np.uint64(0))
    steps[starts] = rest[starts]
    five = planes(steps, 5)
    ends = np.append(starts[1:], len(distinct))
    spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
    told = [flags[a:b].tobytes() for a, b in spans]
    if len(sides):
        before = np.append(0, np.cumsum((flags & SIDED) > 0))
        three = [plane for side in sides for plane in planes(side, 3)]
        told = [x + b"".join(plane[before[a] : before[b]] for plane in three) for x, (a, b) in zip(told, spans, strict=True)]
    return bucket[starts].tolist(), [b"".join(plane[a:b] for plane in five) for a, b in spans], told


def planes(numbers: np.ndarray, width: int) -> list[np.ndarray]:
    """The ``width`` lowest bytes of numbers, an array a byte, the highest first."""
    return [(numbers >> numbers.dtype.type(8 * b)).astype(np.uint8) for b in reversed(range(width))]


def joined(planes: np.ndarray, kind: type) -> np.ndarray:
    """The numbers of which each plane has a byte, the highest first."""
    out = np.zeros(planes.shape[1], kind)
    for plane in planes:
        out = (out << kind(8)) | plane
    return out


def unpacked(names: bytes) -> np.ndarray:
    return np.cumsum(joined(np.frombuffer(names, np.uint8).reshape(5, -1), np.uint64), dtype=np.uint64)


def together(table: pa.Table) -> pa.Table:
    """Of a bucket's rows (batch, names, flags) the flags of all of them together: one row a batch; ``BEFORE`` and ``AFTER`` where the words differ."""
    parts = [unpacked(loosened(x)) for x in table.column("names").to_pylist()]
    told = [np.frombuffer(loosened(x), np.uint8) for x in table.column("flags").to_pylist()]
    names = np.concatenate(parts)
    # the 40 bits of names leave room below for their places
    order = ascending(names << np.uint64(24))
    names = names[order]
    new = np.ones(len(names), bool)
    new[1:] = names[1:] != names[:-1]
    start, group = np.flatnonzero(new), np.cumsum(new) - 1
    flags = np.concatenate([t[: len(x)] for t, x in zip(told, parts, strict=True)])
    nth = np.cumsum((flags & SIDED) > 0) - 1
    flags = flags[order]
    sided = np.flatnonzero(flags & SIDED)
    all_ = (np.diff(start, append=len(names)) > 1) | (flags[start] & 1)
    if (flags & GOODS).any():
        all_ += 2 * np.minimum(np.add.reduceat(((flags & GOODS) >> 1).astype(np.int64), start), 2).astype(np.uint8)
    if len(sided):
        beside = np.concatenate([t[len(x) :].reshape(6, -1) for t, x in zip(told, parts, strict=True)], axis=1)
        at, of = nth[order[sided]], group[sided]
        new = np.ones(len(of), bool)
        new[1:] = of[1:] != of[:-1]
        for side, bit in ((beside[:3], BEFORE), (beside[3:], AFTER)):
            all_[of[new]] |= np.where(alike(joined(side, np.uint32)[at], new) == 0, np.uint8(bit), np.uint8(0))
    out = np.empty(len(names), np.uint8)
    out[order] = all_[group]
    ends = np.cumsum([len(x) for x in parts]).tolist()
    flags_of = [squeezed(out[b - len(x) : b].tobytes()) for x, b in zip(parts, ends, strict=True)]
    return pa.table([*(table.column(c) for c in ("bucket", "batch", "low")), pa.array(flags_of, pa.binary())], names=["bucket", "batch", "low", "flags"])


def cut(to: Sequence[int], start: int, end: int) -> int:
    """The number of phrases of the greedy cross-parsing from ``start``, from the end of the phrase that begins at each word."""
    n = 0
    while start < end:
        start = to[start]
        n += 1
    return n


def own_phrases(text: Sequence) -> int:
    """The number of phrases of the Lempel-Ziv (1978) parsing; an unfinished last phrase counts."""
    number = {c: i for i, c in enumerate(dict.fromkeys(text))}
    return own_phrases_of_numbers([number[c] for c in text], len(number))


def own_phrases_of_numbers(text: list[int], many: int) -> int:
    """The same of numbers below ``many``."""
    # a node is told by its number times many, so that with a word it makes one number
    seen: dict[int, int] = {}
    get, node, made = seen.get, 0, 0
    for c in text:
        to = get(node + c)
        if to is None:
            made += many
            seen[node + c] = made
            node = 0
        else:
            node = to
    return made // max(1, many) + (node > 0)


def scores(n: int, cross: int, own: int) -> tuple[float | None, float | None]:
    if n == 0:
        return None, None
    cross_bits = cross * math.log2(n) / n
    return cross_bits, cross_bits - (own * math.log2(own) / n)


_ZSTD = pa.Codec("zstd", compression_level=1)


def squeezed(data: bytes) -> bytes:
    """Compressed, after its length in eight bytes."""
    return len(data).to_bytes(8, "little") + _ZSTD.compress(data, asbytes=True)


def loosened(data: bytes) -> bytes:
    return _ZSTD.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), asbytes=True)


_NAMES = "bucket long, batch long, low long, names binary, flags binary"


def sent(distinct: np.ndarray, flags: np.ndarray, batch: int, low: int, bits: int, sides: Sequence[np.ndarray] = ()) -> pa.Table:
    bucket, parts, told = packed(distinct, flags, bits, sides)
    n, parts, told = len(bucket), [squeezed(x) for x in parts], [squeezed(x) for x in told]
    return pa.table([pa.array(bucket, pa.int64()), pa.array([batch] * n, pa.int64()), pa.array([low] * n, pa.int64()), pa.array(parts, pa.binary()), pa.array(told, pa.binary())], names=["bucket", "batch", "low", "names", "flags"])


def received(answers: pa.Table, names: np.ndarray) -> np.ndarray:
    """The answers to each of the names asked for."""
    return Named(names).of(np.frombuffer(b"".join(map(loosened, answers.sort_by("bucket").column("flags").to_pylist())), np.uint8))


def rows_of(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The rows of ascending words, from each row's first word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(np.searchsorted(at, first)))


class Stretches:
    """The stretches of a batch's rows in which every factor of ``m`` words is in another row, and a word on each side.

    Arrays by kept word: its number ``at`` in the batch, the ``side`` code, and of the factor of m words that begins there
    the ``name`` and ``bits`` (``ELSEWHERE``; 2 in another good row; may be a match's start, ``BEFORE``; its end, ``AFTER``).
    """

    COLUMNS = {"first": np.int64, "good": np.int8, "at": np.int32, "side": np.uint32, "name": np.uint64, "bits": np.uint8}

    def __init__(self, m: int, first: np.ndarray, good: np.ndarray, at: np.ndarray, side: np.ndarray, name: np.ndarray, bits: np.ndarray) -> None:
        self.m, self.first, self.good, self.at, self.side, self.name, self.bits = m, first, good, at, side, name, bits
        self.row = rows_of(first, at)
        self.there = (bits & ELSEWHERE) > 0

    @classmethod
    def of(cls, m: int, first: np.ndarray, good: np.ndarray, at: np.ndarray, side: np.ndarray, begins: np.ndarray, name: np.ndarray, flags: np.ndarray) -> Stretches:
        """From the factors of m words that begin at the kept words ``begins``, and the answers to them."""
        yes = (flags & ELSEWHERE) > 0
        begins, name, flags = begins[yes], name[yes], flags[yes]
        row = rows_of(first, at[begins])
        start, end = at[begins] == first[row], at[begins] + m == first[row + 1]
        bits = np.zeros(len(at), np.uint8)
        fine = ((flags & GOODS) >> 1).astype(np.int64) > good[row]
        bits[begins] = ELSEWHERE + 2 * fine + BEFORE * (start | ((flags & BEFORE) > 0)) + AFTER * (end | ((flags & AFTER) > 0))
        names = np.zeros(len(at), np.uint64)
        names[begins] = name
        edge = np.bincount(np.maximum(begins - 1, 0), minlength=len(at) + 1) - np.bincount(np.minimum(begins + m + 1, len(at)), minlength=len(at) + 1)
        kept = np.cumsum(edge[:-1]) > 0
        return cls(m, first, good, at[kept], side[kept], names[kept], bits[kept])

    def split(self, most: int) -> list[tuple[int, Stretches]]:
        """(first row, stretches) of parts that ask for some ``most`` names, or of one row."""
        low, high = (int(self.row[0]), int(self.row[-1])) if len(self.row) else (0, 0)
        if low == high or self.asks <= most:
            return [(low, self)] if self.asks else []
        half = min(max(int(np.searchsorted(self.row, self.row[len(self.row) // 2])), 1), len(self.row) - 1)
        half = half if self.row[half - 1] != self.row[half] else int(np.searchsorted(self.row, low, side="right"))
        both = [Stretches(self.m, self.first, self.good, *(x[part] for x in (self.at, self.side, self.name, self.bits))) for part in (slice(0, half), slice(half, None))]
        return [x for part in both for x in part.split(most)]

    @cached_property
    def doubled(self) -> np.ndarray:
        """Where factors of 2m words begin, both halves of which are elsewhere."""
        k = np.flatnonzero(self.there[: max(0, len(self.at) - self.m)])
        return k[self.there[k + self.m] & (self.at[k + self.m] == self.at[k] + self.m) & (self.row[k + self.m] == self.row[k])]

    @cached_property
    def periods(self) -> tuple[np.ndarray, np.ndarray]:
        """For each kept word how far before it, by less than m, the row has the same factor (0: not), and the last word up to which that goes on."""
        n = len(self.at)
        back, last = np.zeros(n, np.int64), np.arange(n)
        k = np.flatnonzero(self.there)
        order = k[ascending(self.name[k])]
        a, b = order[:-1], order[1:]
        same = (self.name[a] == self.name[b]) & (self.row[a] == self.row[b]) & (self.at[b] - self.at[a] < self.m)
        back[b[same]] = (self.at[b] - self.at[a])[same]
        if n:
            stop = np.append((back[1:] != back[:-1]) | (self.at[1:] != self.at[:-1] + 1) | (self.row[1:] != self.row[:-1]), True)
            stops = np.flatnonzero(stop)
            last = np.repeat(stops, np.diff(stops, prepend=-1))
        return back, last

    @cached_property
    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts of matches of m + 1 to 2m - 1 words, all ends' last factors, and for each start which of these it asks for (from, to)."""
        n = len(self.at)
        starts = np.flatnonzero(self.there & ((self.bits & BEFORE) > 0))
        end = self.there & ((self.bits & AFTER) > 0)
        ends, before = np.flatnonzero(end), np.append(0, np.cumsum(end))
        broken = np.ones(n + 1, bool)
        if n:
            broken[1:n] = ~self.there[1:] | (self.at[1:] != self.at[:-1] + 1) | (self.row[1:] != self.row[:-1])
        breaks = np.flatnonzero(broken)
        stop = np.minimum(np.repeat(breaks[1:], np.diff(breaks))[starts], starts + self.m)
        back, last = self.periods
        # what ends within the period was asked for a period before, but for the end of the text
        last = last[starts]
        closes = self.at[last] + self.m == self.first[self.row[last] + 1]
        low = np.maximum(np.where(back[starts] > 0, last + ~closes, 0), starts + 1)
        a = before[low]
        return starts, ends, a, np.maximum(before[stop], a)

    @cached_property
    def asks(self) -> int:
        _, _, a, b = self.spans
        return len(self.doubled) + int((b - a).sum())

    def ask(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(names, where they begin, how many words long, number of those of 2m words, which come first)."""
        twice = self.doubled
        starts, ends, a, b = self.spans
        count = b - a
        begin = np.repeat(starts, count)
        to = ends[np.arange(len(begin)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)]
        with np.errstate(over="ignore"):
            long = mix(self.name[twice] * _GOLD ^ mix(self.name[twice + self.m]))
            between = mix(self.name[begin] * _BASE + mix(self.name[to] + (to - begin).astype(np.uint64) * _GOLD))
        length = np.append(np.full(len(twice), 2 * self.m), self.m + to - begin)
        return np.append(long, between), np.append(twice, begin), length, len(twice)

    def send(self, batch: int, low: int, bits: int) -> pa.Table:
        names, begin, length, n = self.ask()
        twice = begin[:n]
        row = self.row[twice]
        left = np.where(self.at[twice] == self.first[row], np.uint32(1), self.side[np.maximum(twice - 1, 0)])
        after = twice + 2 * self.m
        right = np.where(self.at[twice] + 2 * self.m == self.first[row + 1], np.uint32(1), self.side[np.minimum(after, len(self.side) - 1)])
        named = Named(names)
        sided, sides = named.sides(0, n, left, right)
        return sent(named.distinct, named.flags(self.row[begin], self.good) | sided, batch, low, bits, sides)

    def take(self, answers: pa.Table) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], Stretches]:
        """Matches of m + 1 to 2m - 1 words (where, how long: elsewhere and in good rows), and the stretches of 2m words."""
        names, begin, length, n = self.ask()
        flags = received(answers, names)
        k, size, told = begin[n:], length[n:], flags[n:]
        found = np.zeros((2, len(self.at)), np.int64)
        for best, yes in zip(found, ((told & ELSEWHERE) > 0, ((told & GOODS) >> 1).astype(np.int64) > self.good[self.row[k]]), strict=True):
            np.maximum.at(best, k[yes], size[yes])
        starts = np.flatnonzero(self.there & ((self.bits & BEFORE) > 0))
        back, last = self.periods
        again = starts[back[starts] > 0]
        for best in found:
            for i, d, most in zip(again.tolist(), back[again].tolist(), (last[again] + self.m - again).tolist(), strict=True):
                earlier = min(best[i - d], most)
                if earlier > best[i]:
                    best[i] = earlier
        some = np.flatnonzero(found.any(axis=0))
        after = Stretches.of(2 * self.m, self.first, self.good, self.at, self.side, begin[:n], names[:n], flags[:n])
        return (self.at[some], found[0, some], found[1, some]), after

    def matches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The matches of m words that are a start's."""
        k = np.flatnonzero(self.there & ((self.bits & BEFORE) > 0))
        return self.at[k], np.full(len(k), self.m), np.where((self.bits[k] & 2) > 0, self.m, 0)


_STATE = "batch long, low long, asks long, size long, first binary, good binary, at binary, side binary, name binary, bits binary, any binary, fine binary"


def states(batch: int, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], after: Stretches, most: int) -> pa.Table:
    """Rows of ``_STATE``: matches (without ``asks``), and stretches that ask for more."""
    at, any_, fine = (np.concatenate([f[i] for f in [*found, after.matches()]]).astype(np.int32).tobytes() for i in range(3))
    rows = [{"batch": batch, "at": at, "any": any_, "fine": fine}] if at else []
    for low, part in after.split(most):
        columns = {c: getattr(part, c).astype(t) for c, t in Stretches.COLUMNS.items()}
        # steps, as nearly all of them are 1
        columns["at"] = np.diff(columns["at"], prepend=np.int32(0))
        rows.append({"batch": batch, "low": low, "asks": part.asks, "size": sum(x.nbytes for x in columns.values())} | {c: x.tobytes() for c, x in columns.items()})
    return pa.Table.from_pylist(rows, _ARROW)


def _schema(columns: str) -> pa.Schema:
    return pa.schema([(name, pa.int64() if kind == "long" else pa.binary()) for name, kind in (x.split() for x in columns.split(", "))])


_ARROW = _schema(_STATE)


def each(tables: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows, one at a time."""
    for table in tables:
        for i in range(len(table)):
            yield table.slice(i, 1).to_pylist()[0]


def stretches(row: dict, m: int) -> Stretches:
    columns = {c: np.frombuffer(row[c], t) for c, t in Stretches.COLUMNS.items()}
    return Stretches(m, **columns | {"at": np.cumsum(columns["at"], dtype=np.int32)})


def finish(table: pa.Table, m: int, most: int) -> pa.Table:
    """All further rounds of all stretches there are: rows of ``_STATE`` of the matches."""
    left, out = [(r["batch"], r["low"], stretches(r, m)) for r in table.to_pylist()], []
    while left:
        answers = together(pa.concat_tables([part.send(batch, low, 0) for batch, low, part in left]))
        next_ = []
        for i, (batch, _, part) in enumerate(left):
            found, after = part.take(answers.slice(i, 1))
            rows = states(batch, [found], after, most)
            out.append(rows.filter(rows.column("asks").is_null()))
            next_ += [(batch, low, x) for low, x in after.split(most)]
        left = next_
    return pa.concat_tables(out)


def sealed(table: pa.Table, batch: int) -> dict:
    """A row of ``_SEALED``, of a table of (d, t, good): texts as numbers of their words, common words first, a plane a byte."""
    raw, offsets = text_buffer(table.column("t"))
    # temporaries of a slice stay in the cache
    parts = [word_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets, HASH_BYTES)]
    words, n = (np.concatenate([x, *y]) for x, y in ((np.zeros(0, np.uint64), [w for w, _ in parts]), (np.zeros(0, np.int64), [np.diff(f) for _, f in parts])))
    named = Named(words)
    count = np.diff(named.start, append=len(words))
    by_count = np.argsort(-count, kind="stable")
    number = np.empty(len(count), np.uint32)
    number[by_count] = np.arange(len(count))
    sink = pa.BufferOutputStream()
    rows = table.select(["d", "good"]).append_column("n", pa.array(n))
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(rows)
    return {
        "batch": batch, "rows": sink.getvalue().to_pybytes(), "bytes": pc.sum(pc.binary_length(table.column("t"))).as_py() or 0, "words": squeezed(b"".join(planes(named.of(number), 4))),
        # of words that are as common the hashes ascend
        "known": squeezed(b"".join(planes(np.diff(named.distinct[by_count], prepend=np.uint64(0)), 8))),
    }


_SEALED = "batch long, rows binary, known binary, words binary, bytes long"
#: What a row counts in a batch beside its text; bytes of text that are hashed at once.
ROW_BYTES, HASH_BYTES = 16, 1 << 18


def batches(tables: Iterator[pa.RecordBatch], batch_bytes: int, first: int) -> Iterator[dict]:
    """Rows of ``_SEALED`` numbered from ``first``, of consecutive rows of some ``batch_bytes``, or of one row of more."""
    held: list[pa.Table] = []
    size = 0
    for x in tables:
        table, low = pa.Table.from_batches([x]), 0
        ends = np.cumsum(pc.fill_null(pc.binary_length(table.column("t")), 0).to_numpy().astype(np.int64) + ROW_BYTES)
        while low < len(ends):
            before = int(ends[low - 1]) if low else 0
            high = max(int(np.searchsorted(ends, before + batch_bytes - size, side="right")), low + (not held))
            if high > low:
                held.append(table.slice(low, high - low))
                size += int(ends[high - 1]) - before
            if high < len(ends):
                yield sealed(pa.concat_tables(held), first)
                held, size, first = [], 0, first + 1
            low = high
    if held:
        yield sealed(pa.concat_tables(held), first)


class _Batch:
    """A batch's texts and what has come back of them so far."""

    def __init__(self, row: dict) -> None:
        table = pa.ipc.open_stream(row["rows"]).read_all()
        self.ids = table.column("d")
        self.good = table.column("good").to_numpy().astype(np.int64)
        self.known = np.cumsum(joined(np.frombuffer(loosened(row["known"]), np.uint8).reshape(8, -1), np.uint64), dtype=np.uint64)
        self.number = joined(np.frombuffer(loosened(row["words"]), np.uint8).reshape(4, -1), np.uint32)
        self.words = self.known[self.number]
        self.first = np.append(0, np.cumsum(table.column("n").to_numpy()))
        self.factors = Factors(self.words, self.first)
        self.row = self.factors.row
        self.longest = np.zeros((2, len(self.words)), np.uint8)

    def send(self, names: np.ndarray, places: list[np.ndarray], batch: int, bits: int, sides: bool) -> pa.Table:
        named = Named(names)
        at = np.concatenate(places) if places else np.zeros(0, np.int64)
        flags = named.flags(self.row[at], self.good)
        if not sides:
            return sent(named.distinct, flags, batch, 0, bits)
        # of the longest factors only
        last, n = places[-1] if len(places) == START - 3 else at[:0], len(self.words)
        side = codes(self.known)[self.number]
        left = np.where(last == self.first[self.row[last]], np.uint32(1), side[last - 1])
        right = np.where(last + START == self.factors.end[last], np.uint32(1), side[np.minimum(last + START, n - 1)])
        sided, told = named.sides(len(names) - len(last), len(names), left, right)
        return sent(named.distinct, flags | sided, batch, 0, bits, told)

    def take(self, names: np.ndarray, places: list[np.ndarray], first_length: int, answers: pa.Table) -> np.ndarray:
        """Lengthen the longest matches by the answers; returns them for each factor."""
        flags = received(answers, names)
        at = np.concatenate(places) if places else np.zeros(0, np.int64)
        length = np.repeat(np.arange(first_length, first_length + len(places)), [len(p) for p in places])
        there = (flags & ELSEWHERE) > 0, ((flags & GOODS) >> 1).astype(np.int64) > self.good[self.row[at]]
        for longest, yes in zip(self.longest, there, strict=True):
            # lengths ascend, so the last one written is the longest
            longest[at[yes]] = length[yes]
        return flags

    def first_round(self, answers: pa.Table) -> np.ndarray:
        names, places = short(self.factors)
        there = (self.take(names, places, 1, answers) & ELSEWHERE) > 0
        threes = np.zeros(max(0, len(self.words) - 2), bool)
        threes[places[2]] = there[len(there) - len(places[2]) :]
        return threes

    def kept(self, batch: int) -> pa.Table:
        """What the first round has told, four bits a word, as a row of answers from a bucket of the batch's own: it need not be asked for again."""
        told = self.longest[0] | (self.longest[1] << 2)
        told = np.append(told, np.zeros(len(told) % 2, np.uint8)).reshape(-1, 2)
        told = squeezed((told[:, 0] | (told[:, 1] << 4)).tobytes())
        return pa.table([pa.array([x], t) for x, t in ((-1 - batch, pa.int64()), (batch, pa.int64()), (0, pa.int64()), (b"", pa.binary()), (told, pa.binary()))], names=["bucket", "batch", "low", "names", "flags"])

    def again(self, answers: pa.Table) -> tuple[np.ndarray, pa.Table]:
        """Takes up what was ``kept``; which factors of three words are elsewhere, and the other answers."""
        own = answers.column("bucket").to_numpy() < 0
        told = np.frombuffer(loosened(answers.filter(pa.array(own)).column("flags")[0].as_py()), np.uint8)
        told = np.column_stack([told & 15, told >> 4]).reshape(-1)[: len(self.words)]
        self.longest[0], self.longest[1] = told & 3, told >> 2
        self.factors.grow()
        self.factors.grow()
        return self.longest[0, : max(0, len(told) - 2)] == 3, answers.filter(pa.array(~own))

    def stretches(self, threes: np.ndarray, answers: pa.Table) -> Stretches:
        names, places = longer(self.factors, threes)
        flags = self.take(names, places, 4, answers)
        begins = places[-1] if len(places) == START - 3 else np.zeros(0, np.int64)
        last = len(names) - len(begins)
        return Stretches.of(START, self.first, self.good, np.arange(len(self.words)), codes(self.known)[self.number], begins, names[last:], flags[last:])


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """id, n_symbols, own_phrases, cross_phrases, good_phrases, cross_entropy, relative_entropy, good_entropy of every row.

    The texts are written once by batch, as numbers of their words, and exchanged so in two of three passes, the names of their short factors once in two;
    a round for each doubling exchanges the stretches of text that are left and the names of their factors, until one worker can hold them all.
    """
    text = F.col(text_col).cast("string")
    good = labels.where(f"`{quality_col}` = 1 and `{id_col}` is not null").select(F.col(id_col).alias("d")).distinct().withColumn("good", F.lit(1))
    rows = docs.select(F.col(id_col).alias("d"), text.alias("t")).join(good, "d", "left").select("d", "t", F.coalesce("good", F.lit(0)).alias("good"))

    def seal(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in batches(tables, batch_bytes, TaskContext.get().partitionId() << 32):
            yield pa.RecordBatch.from_pylist([row], _schema(_SEALED))

    # written, so that a row has the same batch in every pass; the words are compressed already
    batched = materialise(rows.mapInArrow(seal, _SEALED), "lm-batches", compression="none")
    total = batched.select(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    bits = max(0, math.ceil(math.log2(max(1, total / bucket_bytes))))
    # of the names that a part of a batch asks for
    most = bucket_bytes // 4

    def first(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each(tables):
            batch = _Batch(row)
            yield from batch.send(*short(batch.factors), row["batch"], bits, False).to_batches()

    def second(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        batch = _Batch(table.to_pylist()[0])
        threes = batch.first_round(answers)
        return pa.concat_tables([batch.send(*longer(batch.factors, threes), key[0].as_py(), bits, True), batch.kept(key[0].as_py())])

    def third(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        """A row a document, and those of ``states``."""
        batch = _Batch(table.to_pylist()[0])
        threes, answers = batch.again(answers)
        left = states(key[0].as_py(), [], batch.stretches(threes, answers), most)
        longest, words, many, bounds = batch.longest, batch.number.tolist(), len(batch.known), batch.first.tolist()
        spans = list(zip(bounds[:-1], bounds[1:], strict=True))
        own = pa.table({
            "d": batch.ids, "batch": pa.array([key[0].as_py()] * len(spans), pa.int64()), "nth": pa.array(range(len(spans)), pa.int64()),
            "own": pa.array([own_phrases_of_numbers(words[a:b], many) for a, b in spans], pa.int64()), "longest": pa.array([longest[:, a:b].tobytes() for a, b in spans], pa.binary()),
        })
        both = pa.concat_tables([own, left], promote_options="default")
        return both.select(read.names)

    def ask(m: int, bits: int):
        def send(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in each(tables):
                yield from stretches(row, m).send(row["batch"], row["low"], bits).to_batches()

        return send

    def taken(m: int):
        def take(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
            found, after = stretches(table.to_pylist()[0], m).take(answers)
            return states(key[0].as_py(), [found], after, most)

        return take

    def rest(m: int):
        def all_rounds(table: pa.Table) -> pa.Table:
            return finish(table, m, most)

        return all_rounds

    def last(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        table = table.sort_by("nth")
        short_ = [np.frombuffer(x, np.uint8).reshape(2, -1) for x in table.column("longest").to_pylist()]
        bounds = np.cumsum([0] + [x.shape[1] for x in short_]).tolist()
        longest = np.concatenate(short_, axis=1).astype(np.int64)
        for f in found.to_pylist():
            at = np.frombuffer(f["at"], np.int32)
            for best, more in zip(longest, (f["any"], f["fine"]), strict=True):
                # a start may be told of at several lengths, once in a row of them at each
                np.maximum.at(best, at, np.frombuffer(more, np.int32))
        # a match's end never falls from one word to the next, nor goes beyond its text
        nth = np.arange(longest.shape[1])
        cross, good = np.maximum(np.maximum.accumulate(longest + nth, axis=1), nth + 1).tolist()
        done = []
        for a, b, mine in zip(bounds[:-1], bounds[1:], table.column("own").to_pylist(), strict=True):
            n, all_, other = b - a, cut(cross, a, b), cut(good, a, b)
            done.append((n, mine, all_, other, *scores(n, all_, mine), scores(n, other, mine)[0]))
        columns = list(zip(*done, strict=True))
        return pa.table([table.column("d"), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.float64()) for c in columns[4:])], names=schema.names)

    long, real = T.LongType(), T.DoubleType()
    schema = T.StructType([
        docs.schema[id_col], *(T.StructField(x, long) for x in free_names(id_col, "n_symbols", "own_phrases", "cross_phrases", "good_phrases")),
        *(T.StructField(x, real) for x in free_names(id_col, "cross_entropy", "relative_entropy", "good_entropy")),
    ])
    state = T.StructType.fromDDL(_STATE)
    read = T.StructType([T.StructField("d", docs.schema[id_col].dataType), *T.StructType.fromDDL("nth long, own long, longest binary"), *state])

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        # what a batch has kept for itself comes back as it is
        return together(table) if key[0].as_py() >= 0 else table.select(["bucket", "batch", "low", "flags"])

    def answered(names: DataFrame) -> DataFrame:
        return materialise(names.groupBy("bucket").applyInArrow(answer, "bucket long, batch long, low long, flags binary"), "lm-answers", compression="zstd")

    by = batched.groupBy("batch")
    one = answered(batched.mapInArrow(first, _NAMES))
    two = answered(by.cogroup(one.groupBy("batch")).applyInArrow(second, _NAMES))
    discard(one)
    base = materialise(by.cogroup(two.groupBy("batch")).applyInArrow(third, read), "lm-short", compression="zstd")
    discard(batched, two)
    left, found, m = base.select(state.names), [], START
    while True:
        of = left.where("asks is null and at is not null").select("batch", "at", "any", "fine")
        found.append(of if m == START else materialise(of, "lm-matches", compression="zstd"))
        more = left.where("asks > 0")
        total, bytes_ = more.select(F.coalesce(F.sum("asks"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
        before, few = left, 8 * total + bytes_ <= 2 * bucket_bytes
        if total == 0:
            break
        if few:
            # few enough for one worker, which ends the rounds at once
            left = materialise(more.groupBy().applyInArrow(rest(m), state), "lm-stretches", compression="zstd")
            found.append(left.select("batch", "at", "any", "fine"))
        else:
            by = more.groupBy("batch", "low")
            # 8 bytes a name
            bits = max(0, math.ceil(math.log2(max(1, 8 * total / bucket_bytes))))
            replies = answered(more.mapInArrow(ask(m, bits), _NAMES))
            left = materialise(by.cogroup(replies.groupBy("batch", "low")).applyInArrow(taken(m), state), "lm-stretches", compression="zstd")
            discard(replies)
        if m > START:
            discard(before)
        if few:
            break
        m *= 2
    matches = found[0]
    for f in found[1:]:
        matches = matches.union(f)
    return base.where("nth is not null").select("batch", "d", "nth", "own", "longest").groupBy("batch").cogroup(matches.groupBy("batch")).applyInArrow(last, schema)
