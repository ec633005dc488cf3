"""Secret scans: all rules in one deterministic automaton, one pass over the bytes.

The rule expressions are parsed here, joined into one non-deterministic automaton,
made deterministic by subset construction over byte classes, minimised by partition
refinement, and laid out as one flat transition array. Texts are scanned in lock-step:
a numpy step advances thousands of segments by one byte each. A segment begins after a
byte (line feed or the separator between texts) at which every state has the same
future, so cutting there loses nothing; nothing the automaton looks for may match a line
feed, and ``Scanner`` refuses a rule that does. Rules whose alphabets would make the automaton
large, or that cross lines, are looked for by how they begin; their expression is then run on
the texts that have it. A segment without such a byte for very long is
walked on its own by the same table. Each accepting position of another rule runs its
reversed automaton back to the leftmost start, so matches are leftmost-longest and do
not overlap within a rule.

Defined results: a null or empty text has no findings; a null id is reported as null;
repeated rows are each scanned; very long texts and lines are scanned to their end; where
matches of one rule begin at one place the longest counts, and where those of several rules
overlap ``redact`` masks all they cover; an empty table gives an empty result; other columns are
neither read nor returned by ``scan`` and pass through ``redact`` untouched; a column of
``scan``'s that has the id column's name has an underscore appended.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import free_names, slices, text_buffer

SEPARATOR = 0xFF
WORD = frozenset(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz")
ANY = frozenset(range(256)) - {10, SEPARATOR}


@dataclass(frozen=True)
class Rule:
    """``pattern`` without an ``anchor`` is scanned for by the automaton, which stays small if its open-ended classes hold word characters only.

    Such a pattern, and an anchor, is ASCII: literals, classes, ``(?:)``, ``|``, ``? * + {m} {m,} {m,n}``, ``\\b`` at either end, ``(?i)`` in front.
    With an anchor, which every match begins with, ``pattern`` is any regular expression over bytes and may cross lines:
    the automaton looks for the anchor, and the expression is run on the texts that have it.
    """

    name: str
    pattern: str
    anchor: str = ""


_VALUE = r"[\"']?[ \t]*[:=][ \t]*[\"']?[!#-&(-~]"
_KEY_END = r"[A-Z ]{0,24}PRIVATE KEY(?: BLOCK)?-----"

RULES = (
    Rule("aws_access_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    Rule("bearer", r"(?i)\bbearer +[0-9a-z._~+/=-]{20,}", r"(?i)\bbearer "),
    Rule("github_token", r"\bgh[oprsu]_[0-9A-Za-z]{36}\b"),
    Rule("google_api_key", r"\bAIza[0-9A-Za-z_-]{35,}", r"\bAIza"),
    Rule("json_web_token", r"\beyJ[0-9A-Za-z_-]{6,}\.eyJ[0-9A-Za-z_-]{6,}\.[0-9A-Za-z_-]{6,}", r"\beyJ"),
    Rule("password", rf"(?i)\b(?:password|passwd|pwd){_VALUE}{{8,}}", r"(?i)\b(?:password|passwd|pwd)[\"']?[ \t]*[:=]"),
    # up to END; of a key that is cut off the lines that are there
    Rule("private_key", rf"-----BEGIN {_KEY_END}(?:(?:-{{0,4}}[^-])*-----END {_KEY_END}|(?:(?:\s*[0-9A-Za-z+/=\\]{{16,}})+(?:\s+[0-9A-Za-z+/=]+)?)?)", r"-----BEGIN "),
    Rule("slack_token", r"\bxox[abeoprs](?:\.xox[bp])?-[0-9A-Za-z-]{10,}", r"\bxox[abeoprs]"),
    Rule("stripe_key", r"\b[prs]k_(?:live|test)_[0-9A-Za-z]{16,}\b"),
    Rule("token", rf"(?i)\b(?:token|secret|api_?key|access_?key|client_?secret){_VALUE}{{16,}}", r"(?i)\b(?:token|secret|api_?key|access_?key|client_?secret)[\"']?[ \t]*[:=]"),
)


def _parse(pattern: str) -> tuple[tuple, bool, bool]:
    """(tree, left boundary, right boundary). Trees: ('set', bytes), ('cat', ...), ('or', ...), ('rep', tree, m, n)."""
    fold = pattern.startswith("(?i)")
    pattern = pattern[4:] if fold else pattern
    left, right = pattern.startswith(r"\b"), pattern.endswith(r"\b")
    pattern = pattern[2 if left else 0 : -2 if right else None]
    at = 0

    def one(chars: Iterable[int]) -> tuple:
        chars = set(chars)
        if fold:
            chars |= {ord(chr(c).swapcase()) for c in chars if chr(c).isalpha() and c < 128}
        return ("set", frozenset(chars))

    def escape(c: str) -> set[int]:
        return {"d": set(b"0123456789"), "w": set(WORD), "s": {9, 11, 12, 13, 32}, "t": {9}}.get(c) or {ord(c)}

    def alternatives() -> tuple:
        nonlocal at
        parts = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("or", *parts)

    def sequence() -> tuple:
        nonlocal at
        items = []
        while at < len(pattern) and pattern[at] not in "|)":
            item = atom()
            if at < len(pattern) and pattern[at] in "?*+{":
                c = pattern[at]
                at += 1
                if c == "{":
                    end = pattern.index("}", at)
                    lo, _, hi = pattern[at:end].partition(",")
                    low, high = int(lo), int(hi) if hi else None if "," in pattern[at:end] else int(lo)
                    at = end + 1
                else:
                    low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
                item = ("rep", item, low, high)
            items.append(item)
        return ("cat", *items)

    def atom() -> tuple:
        nonlocal at
        c = pattern[at]
        at += 1
        if c == "(":
            if pattern.startswith("?:", at):
                at += 2
            tree = alternatives()
            at += 1
            return tree
        if c == ".":
            return ("set", ANY)
        if c == "\\":
            at += 1
            return one(escape(pattern[at - 1]))
        if c != "[":
            return one({ord(c)})
        negated = pattern[at] == "^"
        at += negated
        chars: set[int] = set()
        while pattern[at] != "]":
            c = pattern[at]
            at += 1
            if c == "\\":
                chars |= escape(pattern[at])
                at += 1
            elif pattern[at] == "-" and pattern[at + 1] != "]":
                chars |= set(range(ord(c), ord(pattern[at + 1]) + 1))
                at += 2
            else:
                chars.add(ord(c))
        at += 1
        return ("set", ANY - one(chars)[1]) if negated else one(chars)

    return alternatives(), left, right


def _reversed(tree: tuple) -> tuple:
    kind, *rest = tree
    if kind == "set":
        return tree
    if kind == "rep":
        return (kind, _reversed(rest[0]), *rest[1:])
    parts = [_reversed(x) for x in rest]
    return (kind, *(parts[::-1] if kind == "cat" else parts))


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree: tuple, start: int) -> int:
        """Thompson's construction from ``start``; the state that is reached."""
        kind, *rest = tree
        if kind == "set":
            end = self.state()
            self.moves[start].append((rest[0], end))
            return end
        if kind == "cat":
            for part in rest:
                start = self.add(part, start)
            return start
        if kind == "or":
            end = self.state()
            for part in rest:
                begin = self.state()
                self.empty[start].append(begin)
                self.empty[self.add(part, begin)].append(end)
            return end
        part, low, high = rest
        for _ in range(low):
            start = self.add(part, start)
        end = self.state()
        self.empty[start].append(end)
        if high is None:
            loop = self.state()
            self.empty[start].append(loop)
            after = self.add(part, loop)
            self.empty[after] += [loop, end]
        else:
            for _ in range(high - low):
                start = self.add(part, start)
                self.empty[start].append(end)
        return end


@dataclass
class Automaton:
    """A minimal deterministic automaton. ``table`` is flat: entries and states are row starts; accepting rows come last."""

    table: np.ndarray
    classes: np.ndarray
    width: int
    start: int
    first_accepting: int
    accepts: dict[int, tuple[int, ...]]
    dead: int

    @property
    def states(self) -> int:
        return len(self.table) // self.width


def _determinise(nfa: _Nfa, start: int, ends: dict[int, int]) -> Automaton:
    """Subset construction over byte classes, then partition refinement to the minimal automaton."""
    closures: dict[int, frozenset] = {}

    def closure(s: int) -> frozenset:
        if s not in closures:
            seen, todo = {s}, [s]
            while todo:
                for t in nfa.empty[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            closures[s] = frozenset(seen)
        return closures[s]

    sets = sorted({chars for moves in nfa.moves for chars, _ in moves}, key=sorted)
    signature: dict[tuple, int] = {}
    classes = np.zeros(256, np.uint8)
    members: list[int] = []
    for byte in range(256):
        key = tuple(byte in chars for chars in sets)
        if key not in signature:
            signature[key] = len(signature)
            members.append(byte)
        classes[byte] = signature[key]
    width = len(members)
    of_class = {chars: [c for c, byte in enumerate(members) if byte in chars] for chars in sets}

    first = closure(start)
    index, todo, rows = {first: 0}, [first], []
    while todo:
        current = todo.pop()
        targets: list[set[int]] = [set() for _ in range(width)]
        for s in current:
            for chars, t in nfa.moves[s]:
                for c in of_class[chars]:
                    targets[c] |= closure(t)
        row = []
        for target in map(frozenset, targets):
            if target not in index:
                index[target] = len(index)
                todo.append(target)
            row.append(index[target])
        rows.append((index[current], row))
    table = np.empty((len(index), width), np.int64)
    for i, row in rows:
        table[i] = row
    found = {i: tuple(sorted({ends[s] for s in states if s in ends})) for states, i in index.items()}

    label = {x: i for i, x in enumerate(sorted(set(found.values())))}
    block = np.array([label[found[i]] for i in range(len(index))])
    while True:
        _, refined = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        refined = refined.ravel()
        if refined.max() == block.max():
            break
        block = refined
    n = int(block.max()) + 1
    some = np.zeros(n, np.int64)
    some[block] = np.arange(len(block))
    accepting = np.array([bool(found[int(some[b])]) for b in range(n)])
    place = np.empty(n, np.int64)
    place[np.argsort(accepting, kind="stable")] = np.arange(n)
    flat = np.empty((n, width), np.int64)
    flat[place] = place[block[table[some]]]
    stuck = np.flatnonzero((flat == np.arange(n)[:, None]).all(axis=1))
    stuck = [int(s) for s in stuck if s < n - accepting.sum()]
    return Automaton(
        (flat * width).astype(np.int32).ravel(), classes, width, int(place[block[0]]) * width, int(n - accepting.sum()) * width,
        {int(place[b]) * width: found[int(some[b])] for b in range(n) if accepting[b]}, stuck[0] * width if stuck else -1,
    )


class Scanner:
    """The forward automaton of all rules and a backward one for each."""

    def __init__(self, rules: Iterable[Rule] = RULES) -> None:
        self.rules = tuple(rules)
        self.edges: list[tuple[bool, bool]] = []
        self.whole = [re.compile(r.pattern.encode()) if r.anchor else None for r in self.rules]
        nfa, ends, self.back = _Nfa(), {}, []
        start = nfa.state()
        nfa.moves[start].append((frozenset(range(256)), start))
        outside = frozenset(range(256)) - WORD
        for i, rule in enumerate(self.rules):
            tree, left, right = _parse(rule.anchor or rule.pattern)
            self.edges.append((left, right))
            whole = ("cat", *([("set", outside)] if left else []), tree, *([("set", outside)] if right else []))
            begin = nfa.state()
            nfa.empty[start].append(begin)
            ends[nfa.add(whole, begin)] = i
            back = _Nfa()
            origin = back.state()
            self.back.append(_determinise(back, origin, {back.add(_reversed(tree), origin): 0}))
        self.forward = a = _determinise(nfa, start, ends)
        rows = a.table.reshape(-1, a.width)
        for byte in (10, SEPARATOR):
            after = rows[rows[:, a.classes[byte]] // a.width]
            if not (after == after[0]).all():
                raise ValueError("a rule matches across a line feed")
        self.fresh = int(rows[0, a.classes[SEPARATOR]])

    def ends(self, buffer: np.ndarray, long: int = 8192) -> list[tuple[int, int]]:
        """(position after the last byte read, accepting state) of the hits of one pass; ``buffer`` begins and ends with a separator."""
        a, hits = self.forward, []
        if len(buffer) < 2:
            return hits
        cuts = np.flatnonzero((buffer == 10) | (buffer == SEPARATOR)) + 1
        starts = cuts[:-1]
        # whole lines are joined into segments of about 1 KiB: one for each KiB in which a line begins
        starts = starts[np.flatnonzero(np.diff(starts >> 10, prepend=-1))]
        lengths = np.diff(starts, append=len(buffer))
        classes = a.classes[buffer].astype(np.int32)
        for s, n in zip(starts[lengths > long].tolist(), lengths[lengths > long].tolist(), strict=True):
            table, state, bound = a.table.tolist(), self.fresh, a.first_accepting
            for at, c in enumerate(classes[s : s + n].tolist(), s + 1):
                state = table[state + c]
                if state >= bound:
                    hits.append((at, state))
        keep = lengths <= long
        starts, lengths = starts[keep], lengths[keep]
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        if len(starts) == 0:
            return hits
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left").tolist()
        state = np.full(len(starts), self.fresh, np.int32)
        at = starts.copy()
        for n in active:
            now, place = state[:n], at[:n]
            np.add(now, classes.take(place), out=now)
            a.table.take(now, out=now, mode="clip")
            place += 1
            if now.max() >= a.first_accepting:
                where = np.flatnonzero(now >= a.first_accepting)
                hits += zip(place[where].tolist(), now[where].tolist(), strict=True)
        return hits

    def spans(self, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, rule, start, end) in bytes within each text, ordered."""
        n = len(offsets) - 1
        buffer = np.full(len(raw) + n + 1, SEPARATOR, np.uint8)
        text_of = np.repeat(np.arange(n), np.diff(offsets))
        buffer[np.arange(len(raw)) + text_of + 1] = raw
        begin = offsets[:-1] + np.arange(n) + 1
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        anchored: set[tuple[int, int]] = set()
        for stop, state in self.ends(buffer):
            for rule in self.forward.accepts[state]:
                left, right = self.edges[rule]
                end = stop - right
                text = int(np.searchsorted(begin, end - 1, side="right")) - 1
                if self.whole[rule]:
                    anchored.add((text, rule))
                    continue
                back, low = self.back[rule], int(begin[text])
                s, at, best = back.start, end, -1
                while at > low and s != back.dead:
                    at -= 1
                    s = int(back.table[s + int(back.classes[buffer[at]])])
                    if s >= back.first_accepting and (not left or int(buffer[at - 1]) not in WORD):
                        best = at
                if best >= 0:
                    found.setdefault((text, rule), []).append((best - low, end - low))
        out = []
        for text, rule in anchored:
            out += [(text, rule, *m.span()) for m in self.whole[rule].finditer(raw[offsets[text] : offsets[text + 1]].tobytes())]
        for (text, rule), places in found.items():
            last = 0
            for s, e in sorted(set(places), key=lambda x: (x[0], -x[1])):
                if s >= last:
                    out.append((text, rule, s, e))
                    last = e
        return sorted(out)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row a finding: id, rule, nth (from 1, within the text and rule), start_byte, end_byte, secret. Row-local; no shuffle."""
    names = free_names(id_col, "rule", "nth", "start_byte", "end_byte", "secret")
    kinds = (T.StringType(), T.IntegerType(), T.LongType(), T.LongType(), T.StringType())
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))])

    scanner = _scanner(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            for lo, hi in slices(offsets):
                part, off = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                spans = scanner.spans(part, off)
                if not spans:
                    continue
                nth, last = [], None
                for text, rule, _, _ in spans:
                    nth.append(nth[-1] + 1 if last == (text, rule) else 1)
                    last = (text, rule)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array([lo + s[0] for s in spans])), pa.array([scanner.rules[s[1]].name for s in spans]),
                    pa.array(nth, pa.int32()), pa.array([s[2] for s in spans], pa.int64()), pa.array([s[3] for s in spans], pa.int64()),
                    pa.array([part[off[s[0]] + s[2] : off[s[0]] + s[3]].tobytes().decode() for s in spans]),
                ], names=schema.names)

    return docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def redacted(text: Column, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> Column:
    """The text with each found secret replaced by ``mark``; a null stays null, a clean text stays as it is."""

    scanner = _scanner(rules)

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        pieces = []
        raw, offsets = text_buffer(texts)
        for lo, hi in slices(offsets):
            part, off = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            found: dict[int, list[tuple[int, int]]] = {}
            for t, _, s, e in scanner.spans(part, off):
                found.setdefault(t, []).append((s, e))
            piece = texts.slice(lo, hi - lo)
            if found:
                values = piece.to_pylist()
                for t, places in found.items():
                    data, out, last = part[off[t] : off[t + 1]].tobytes(), [], 0
                    for s, e in sorted(places):
                        if s >= last:
                            out += [data[last:s], mark.encode()]
                        last = max(last, e)
                    values[t] = b"".join([*out, data[last:]]).decode()
                piece = pa.array(values, pa.string())
            pieces.append(piece.cast(pa.string()))
        return pa.concat_arrays(pieces) if pieces else pa.array([], pa.string())

    return run(text)


_kept: dict[tuple, Scanner] = {}


def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _kept:
        _kept[rules] = Scanner(rules)
    return _kept[rules]


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row and column of ``docs``, secrets masked in the text; ``chars_col``, where there is one, counts the new text."""
    out = docs.withColumn(text_col, redacted(F.col(text_col).cast("string"), rules))
    if chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        out = out.withColumn(chars_col, F.when(F.col(chars_col).isNotNull(), F.length(text_col)).cast(kind))
    return out
