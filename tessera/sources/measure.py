"""Facts of one file of Python source, from CPython's ``ast`` and ``tokenize``: plain Python, no Spark.

``Source`` holds a parsed file; the functions below measure functions, classes and the
file. An ``elif`` is a clause of its ``if``, never a statement of its own.
"""

from __future__ import annotations

import ast
import io
import keyword
import re
import token
import tokenize
import warnings
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np

DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
SCOPES = (*DEFS, ast.ClassDef)
LOOPS = (ast.For, ast.AsyncFor, ast.While)
WITHS = (ast.With, ast.AsyncWith)
TRIES = (ast.Try, ast.TryStar)
COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
CONSTRUCTORS = ("__init__", "__new__", "__post_init__")
_BRANCH = frozenset("if elif for while except and or".split())
_TRIVIA = frozenset((tokenize.COMMENT, tokenize.NL, tokenize.ENDMARKER, tokenize.INDENT, tokenize.DEDENT))


class Source:
    """A file's text, lines, tokens and tree; raises SyntaxError where it does not parse."""

    def __init__(self, text: str) -> None:
        text = text.removeprefix("﻿")
        self.text = text
        self.lines = text.split("\n")
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            try:
                self.tree = ast.parse(text)
                self.tokens = list(tokenize.generate_tokens(io.StringIO(text).readline))
            except (ValueError, RecursionError, MemoryError, tokenize.TokenError, IndentationError) as e:
                raise SyntaxError(str(e)) from e
        self.body = self.tree.body
        self.comments = [(t.start[0], t.start[1], t.string) for t in self.tokens if t.type == tokenize.COMMENT]
        self.functions = [n for n in pre_order(self) if isinstance(n, DEFS)]
        self.classes = [n for n in pre_order(self) if isinstance(n, ast.ClassDef)]
        cases = [self.start(c.pattern) for n in ast.walk(self.tree) if isinstance(n, ast.Match) for c in n.cases]
        self.branches = sorted([t.start for t in self.tokens if t.type == tokenize.NAME and t.string in _BRANCH] + cases)

    def column(self, line: int, byte: int) -> int:
        """Characters before a byte of a line."""
        text = self.lines[line - 1]
        return byte if text.isascii() else len(text.encode()[:byte].decode("utf-8", "ignore"))

    def start(self, node: ast.AST) -> tuple[int, int]:
        """(line from 1, characters before it), decorators included."""
        if getattr(node, "decorator_list", None):
            first = node.decorator_list[0]
            line = first.lineno
            return line, self.lines[line - 1].rfind("@", 0, self.column(line, first.col_offset))
        return node.lineno, self.column(node.lineno, node.col_offset)

    def end(self, node: ast.AST) -> tuple[int, int]:
        return node.end_lineno, self.column(node.end_lineno, node.end_col_offset)

    def name_at(self, node: ast.AST) -> tuple[int, int]:
        """Where the name of a function or class stands."""
        line, col = node.lineno, self.column(node.lineno, node.col_offset)
        found = re.compile(r"(?:async\s+)?(?:def|class)\s+").match(self.lines[line - 1], col)
        return (line, found.end()) if found else (line, col)

    def is_elif(self, node: ast.AST) -> bool:
        return isinstance(node, ast.If) and self.lines[node.lineno - 1].encode()[node.col_offset :].startswith(b"elif")

    def clauses(self, node: ast.If) -> list[tuple[ast.expr | None, list[ast.stmt]]]:
        """The elif and else clauses of an if: (test or None, body)."""
        out, rest = [], node.orelse
        while len(rest) == 1 and self.is_elif(rest[0]):
            out.append((rest[0].test, rest[0].body))
            rest = rest[0].orelse
        return [*out, (None, rest)] if rest else out

    def blocks(self, node: ast.stmt) -> list[list[ast.stmt]]:
        """The statement lists directly inside a compound statement."""
        if isinstance(node, ast.If):
            return [node.body, *(b for _, b in self.clauses(node))]
        if isinstance(node, LOOPS):
            return [node.body, node.orelse]
        if isinstance(node, TRIES):
            return [node.body, *(h.body for h in node.handlers), node.orelse, node.finalbody]
        if isinstance(node, ast.Match):
            return [c.body for c in node.cases]
        return [node.body] if isinstance(node, (*WITHS, *SCOPES)) else []


def pre_order(source: Source, body: list[ast.stmt] | None = None) -> Iterator[ast.stmt]:
    """Every statement in source order, an elif not among them."""
    todo = list(reversed(source.body if body is None else body))
    while todo:
        node = todo.pop()
        yield node
        for block in reversed(source.blocks(node)):
            todo += reversed(block)


def own(nodes: list[ast.AST], stop: tuple = (*SCOPES, ast.Lambda)) -> Iterator[ast.AST]:
    """All nodes below ``nodes`` that are not of, or inside, the ``stop`` kinds."""
    todo = list(nodes)
    while todo:
        node = todo.pop()
        if not isinstance(node, stop):
            yield node
            todo += ast.iter_child_nodes(node)


def trailing(node: ast.expr | None) -> str | None:
    """The last identifier of a name, attribute, call or subscript."""
    while isinstance(node, (ast.Call, ast.Subscript)):
        node = node.func if isinstance(node, ast.Call) else node.value
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


def name_of(node: ast.expr | None) -> str | None:
    """The identifier of a name, or the last of an attribute; nothing of a call."""
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


def docstring(body: list[ast.stmt]) -> ast.Constant | None:
    first = body[0] if body else None
    return first.value if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str) else None


def doc_lines(body: list[ast.stmt]) -> int:
    doc = docstring(body)
    return doc.end_lineno - doc.lineno + 1 if doc else 0


# ---- functions ----------------------------------------------------------------------------------------------------


def cyclomatic(source: Source, function: ast.stmt) -> int:
    """1 + branch tokens in the function's range that are not in a function inside it."""

    def within(node: ast.stmt) -> int:
        return bisect_left(source.branches, source.end(node)) - bisect_left(source.branches, source.start(node))

    def outermost(body: list[ast.stmt]) -> Iterator[ast.stmt]:
        for node in body:
            if isinstance(node, DEFS):
                yield node
            else:
                for block in source.blocks(node):
                    yield from outermost(block)

    return 1 + within(function) - sum(map(within, outermost(function.body)))


def cognitive(source: Source, body: list[ast.stmt], nesting: int = 0) -> int:
    def within(node: ast.AST | None) -> int:
        score = 0
        for x in ast.walk(node) if node is not None else ():
            if isinstance(x, ast.BoolOp):
                score += 1
            elif isinstance(x, ast.IfExp):
                score += 1 + nesting
            elif isinstance(x, COMPREHENSIONS):
                score += sum(len(g.ifs) for g in x.generators) * (1 + nesting)
        return score

    score = 0
    for node in body:
        deeper = [(b, nesting + 1) for b in source.blocks(node)]
        if isinstance(node, ast.If):
            clauses = source.clauses(node)
            score += 1 + nesting + within(node.test) + len(clauses) + sum(within(t) for t, _ in clauses)
        elif isinstance(node, LOOPS):
            score += 1 + nesting + within(node.test if isinstance(node, ast.While) else node.iter)
        elif isinstance(node, TRIES):
            score += len(node.handlers) * (1 + nesting)
            deeper = [(b, nesting) for b in (node.body, node.orelse, node.finalbody)] + [(h.body, nesting + 1) for h in node.handlers]
        elif isinstance(node, WITHS):
            score += sum(within(i.context_expr) for i in node.items)
            deeper = [(node.body, nesting)]
        elif isinstance(node, ast.Match):
            score += 1 + nesting + within(node.subject) + sum(within(c.guard) for c in node.cases)
        elif isinstance(node, DEFS):
            deeper = []
        elif isinstance(node, ast.ClassDef):
            deeper = [(node.body, nesting)]
        else:
            score += within(node)
        score += sum(cognitive(source, b, n) for b, n in deeper)
    return score


def max_nesting(source: Source, body: list[ast.stmt], depth: int = 0) -> int:
    """match and definitions add no depth and are not entered."""
    kinds = (ast.If, *LOOPS, *WITHS, *TRIES)
    return max([depth, *(max_nesting(source, b, depth + 1) for node in body if isinstance(node, kinds) for b in source.blocks(node))])


def statements(source: Source, body: list[ast.stmt], scopes: bool) -> int:
    """Statements of a body and of the blocks inside it; definitions are entered only with ``scopes``."""
    return sum(1 + sum(statements(source, b, scopes) for b in source.blocks(n) if scopes or not isinstance(n, SCOPES)) for n in body)


def is_static(function: ast.stmt) -> bool:
    return any(name_of(d) == "staticmethod" for d in function.decorator_list)


def positional(function: ast.stmt) -> list[ast.arg]:
    return [*function.args.posonlyargs, *function.args.args]


def has_receiver(function: ast.stmt) -> bool:
    first = positional(function)
    return bool(first) and not is_static(function) and first[0].arg in ("self", "cls")


def function_facts(source: Source, node: ast.stmt) -> dict:
    a = node.args
    named = [*positional(node), *a.kwonlyargs]
    params = len(named) + (a.vararg is not None) + (a.kwarg is not None)
    receiver = has_receiver(node)
    loops = comparisons = numbers = strings = maths = exits = 0
    variables, words = set(), set()
    inside = {id(x) for s in node.body for f in ast.walk(s) if isinstance(f, ast.JoinedStr) for x in f.values if isinstance(x, ast.Constant)}
    for x in own(node.body):
        if isinstance(x, LOOPS):
            loops += 1
        elif isinstance(x, COMPREHENSIONS):
            loops += len(x.generators)
        elif isinstance(x, ast.Compare):
            comparisons += len(x.ops)
        elif isinstance(x, ast.Constant):
            numbers += isinstance(x.value, (int, float, complex)) and not isinstance(x.value, bool)
            strings += isinstance(x.value, str) and id(x) not in inside
        elif isinstance(x, ast.JoinedStr):
            strings += 1
        elif isinstance(x, ast.BinOp):
            maths += 1
        elif isinstance(x, ast.Name):
            words.add(x.id)
            if isinstance(x.ctx, ast.Store):
                variables.add(x.id)
        elif isinstance(x, (ast.Return, ast.Raise, ast.Yield, ast.YieldFrom)):
            exits += 1
    line, col = source.name_at(node)
    kept = named[1:] if receiver else named
    return {
        "name": node.name, "line": line, "column": col + 1, "loc": source.end(node)[0] - source.start(node)[0] + 1,
        "cyclomatic": cyclomatic(source, node), "cognitive": cognitive(source, node.body), "max_nesting": max_nesting(source, node.body),
        "params": params, "arity": params - receiver, "ncss": statements(source, node.body, False), "exits": exits,
        "typed_params": sum(p.annotation is not None for p in kept), "annotatable_params": len(kept), "has_return_annotation": node.returns is not None,
        "has_docstring": docstring(node.body) is not None, "docstring_lines": doc_lines(node.body), "loop_qty": loops, "comparisons_qty": comparisons,
        "numbers_qty": numbers, "string_literals_qty": strings, "math_ops_qty": maths, "variables_qty": len(variables), "unique_words_qty": len(words),
    }


# ---- classes ------------------------------------------------------------------------------------------------------


def _accesses(method: ast.stmt) -> set[str] | None:
    """Names read or written as attributes of the receiver in a method's own scope; None for a static method or one without parameters."""
    first = positional(method)
    if is_static(method) or not first:
        return None
    receiver, found, todo = first[0].arg, set(), list(method.body)
    while todo:
        node = todo.pop()
        if isinstance(node, ast.ClassDef):
            continue
        if isinstance(node, (*DEFS, ast.Lambda)):
            a = node.args
            if receiver in {p.arg for p in (*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg) if p}:
                continue
        if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id == receiver:
            found.add(node.attr)
        todo += ast.iter_child_nodes(node)
    return found


def _groups(n: int, links: list[tuple[int, int]]) -> list[int]:
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    return [find(x) for x in range(n)]


def cohesion(methods: list[ast.stmt]) -> tuple[int, float, float, float]:
    """(components, tight and loose class cohesion, lack of cohesion) over the methods that are no constructors."""
    nodes = [m for m in methods if m.name not in CONSTRUCTORS]
    n = len(nodes)
    if n <= 1:
        return n, 0.0, 0.0, 0.0
    number = {m.name: i for i, m in enumerate(nodes)}
    used, links, users = [set() for _ in nodes], [], {}
    for i, method in enumerate(nodes):
        for name in sorted((_accesses(method) or set()) - set(CONSTRUCTORS)):
            if name in number:
                links.append((i, number[name]))
            else:
                used[i].add(name)
                users.setdefault(name, []).append(i)
    together = [(u[0], x) for u in users.values() for x in u[1:]]
    components = len(set(_groups(n, links + together)))
    direct = [(i, j) for i in range(n) for j in range(i + 1, n) if used[i] & used[j]]
    group = _groups(n, direct)
    pairs = n * (n - 1) // 2
    joined = sum(group.count(g) * (group.count(g) - 1) // 2 for g in set(group))
    star = (n - sum(map(len, users.values())) / len(users)) / (n - 1) if users else 0.0
    return components, len(direct) / pairs, joined / pairs, star


def _type_names(node: ast.expr | None) -> set[str]:
    if isinstance(node, (ast.Name, ast.Attribute)):
        return {name_of(node)}
    if isinstance(node, ast.Subscript):
        return _type_names(node.value) | _type_names(node.slice)
    if isinstance(node, (ast.Tuple, ast.List)):
        return set().union(*map(_type_names, node.elts))
    return _type_names(node.left) | _type_names(node.right) if isinstance(node, ast.BinOp) else set()


def coupled(node: ast.ClassDef) -> list[str]:
    names = {name_of(b) for b in node.bases}
    for x in own(node.body, (ast.ClassDef,)):
        if isinstance(x, DEFS):
            a = x.args
            for p in (*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg):
                names |= _type_names(p.annotation) if p else set()
            names |= _type_names(x.returns)
        elif isinstance(x, ast.AnnAssign):
            names |= _type_names(x.annotation)
        elif isinstance(x, ast.Call):
            names.add(name_of(x.func))
            if name_of(x.func) in ("isinstance", "issubclass") and len(x.args) > 1:
                names |= _type_names(x.args[1])
    return sorted(names - {None})


def class_facts(source: Source, node: ast.ClassDef) -> dict:
    methods = [m for m in node.body if isinstance(m, DEFS)]
    names = {m.name for m in methods}
    components, tcc, lcc, star = cohesion(methods)
    accessed = set().union(*(_accesses(m) or set() for m in methods)) if methods else set()
    calls = [x for m in methods for x in own(m.body, (ast.ClassDef,)) if isinstance(x, ast.Call)]
    static = [
        x.func.value.id for x in own(node.body, (ast.ClassDef,))
        if isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute) and isinstance(x.func.value, ast.Name)
    ]
    bases = [b for b in map(name_of, node.bases) if b]
    abstract = (
        not {"ABC", "Protocol"}.isdisjoint(bases)
        or any(k.arg == "metaclass" and name_of(k.value) == "ABCMeta" for k in node.keywords)
        or any((name_of(d) or "").startswith("abstract") for m in methods for d in m.decorator_list)
    )
    line, col = source.name_at(node)
    return {
        "name": node.name, "line": line, "column": col + 1, "loc": source.end(node)[0] - source.start(node)[0] + 1, "methods": len(methods),
        "attributes": len(accessed - names), "lcom4": components, "tcc": tcc, "lcc": lcc, "lcom_star": star,
        "wmc": sum(cyclomatic(source, m) for m in methods), "rfc": len(names | ({name_of(c.func) for c in calls} - {None})),
        "is_abstract": abstract, "has_docstring": docstring(node.body) is not None, "docstring_lines": doc_lines(node.body),
        "bases": bases, "coupled": coupled(node), "static_calls": sorted(static),
    }


# ---- files --------------------------------------------------------------------------------------------------------


def count_lines(text: str) -> int:
    """Lines ended by line feeds; a last one without counts."""
    return text.count("\n") + (not text.endswith("\n") and text != "")


def nloc(source: Source) -> int:
    """Lines that bear a token other than comments, blank lines and indentation."""
    lines: set[int] = set()
    for t in source.tokens:
        if t.type not in _TRIVIA and t.string.strip("\r\n"):
            lines.update(range(t.start[0], t.end[0] + 1))
    return len(lines)


def _constant(node: ast.expr | None) -> bool:
    if isinstance(node, ast.Constant):
        return True
    if isinstance(node, ast.UnaryOp):
        return _constant(node.operand)
    if isinstance(node, (ast.Tuple, ast.List, ast.Set)):
        return all(map(_constant, node.elts))
    return isinstance(node, ast.Dict) and all(map(_constant, [*node.keys, *node.values]))


def _main_guard(node: ast.stmt) -> bool:
    if not (isinstance(node, ast.If) and isinstance(node.test, ast.Compare) and len(node.test.ops) == 1):
        return False
    sides = (node.test.left, node.test.comparators[0])
    return any(isinstance(a, ast.Name) and a.id == "__name__" and isinstance(b, ast.Constant) and b.value == "__main__" for a, b in (sides, sides[::-1]))


def top_level_code(source: Source) -> int:
    skip = (*SCOPES, ast.Import, ast.ImportFrom, ast.TypeAlias)
    total = 0
    for i, node in enumerate(source.body):
        constant = isinstance(node, (ast.Assign, ast.AnnAssign)) and _constant(node.value)
        if not (isinstance(node, skip) or (i == 0 and docstring([node])) or _main_guard(node) or constant):
            total += statements(source, [node], False)
    return total


def exception_facts(source: Source) -> dict:
    def broad(node: ast.expr) -> bool:
        return any(map(broad, node.elts)) if isinstance(node, ast.Tuple) else name_of(node) in ("Exception", "BaseException")

    def swallows(body: list[ast.stmt]) -> bool:
        only = body[0]
        dots = isinstance(only, ast.Expr) and isinstance(only.value, ast.Constant) and only.value.value is Ellipsis
        return len(body) == 1 and (isinstance(only, (ast.Pass, ast.Continue)) or dots)

    found = [h for h in ast.walk(source.tree) if isinstance(h, ast.ExceptHandler)]
    return {
        "handlers": len(found), "bare": sum(h.type is None for h in found), "broad": sum(h.type is not None and broad(h.type) for h in found),
        "swallow": sum(swallows(h.body) for h in found),
    }


_TEST_PATH = re.compile(r"(^|/)(conftest\.py|test_[^/]*\.py|[^/]*_test\.py)$|(^|/)tests?/")


def is_test_path(path: str) -> bool:
    return _TEST_PATH.search(path) is not None


def _asserts(x: ast.AST) -> bool:
    if isinstance(x, ast.Assert):
        return True
    if not (isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute)):
        return False
    name, on = x.func.attr, x.func.value.id if isinstance(x.func.value, ast.Name) else None
    return (
        re.match("assert[A-Z]", name) is not None or (name == "fail" and on in ("self", "cls")) or (name in ("raises", "warns", "deprecated_call") and on == "pytest")
    )


def test_facts(source: Source, is_test: bool) -> dict:
    def definitions(body: list[ast.stmt], nested: bool) -> Iterator[ast.stmt]:
        for node in body:
            if isinstance(node, SCOPES):
                yield node
                if nested or isinstance(node, ast.ClassDef):
                    yield from definitions(node.body, nested)

    if is_test:
        tests = [n for n in definitions(source.body, False) if isinstance(n, DEFS) and re.match(r"test($|_|[A-Z])", n.name)]
        counts = [sum(map(_asserts, (x for s in t.body for x in ast.walk(s)))) for t in tests]
        return {"test_functions": len(tests), "assertion_free_tests": counts.count(0), "assertions": sum(counts), "production_functions": 0, "with_doctest": 0, "doctest_examples": 0}

    def examples(body: list[ast.stmt]) -> int:
        doc = docstring(body)
        return sum(line.lstrip().startswith(">>>") for line in doc.value.split("\n")) if doc else 0

    found = list(definitions(source.body, True))
    own_examples = [(isinstance(n, DEFS), examples(n.body)) for n in found]
    return {
        "test_functions": 0, "assertion_free_tests": 0, "assertions": 0, "production_functions": sum(f for f, _ in own_examples),
        "with_doctest": sum(f and e > 0 for f, e in own_examples), "doctest_examples": examples(source.body) + sum(e for _, e in own_examples),
    }


def imports(source: Source) -> list[dict]:
    """Every import statement, with whether it is inside a function or under a type-checking test."""
    out: list[dict] = []

    def checking(test: ast.expr | None) -> bool:
        return name_of(test) == "TYPE_CHECKING"

    def walk(body: list[ast.stmt], local: bool, typing: bool) -> None:
        for node in body:
            told = {"line": node.lineno, "top": body is source.body, "type_checking": typing, "local": local}
            if isinstance(node, ast.Import):
                out.extend({"level": 0, "module": a.name, "names": [], **told, "line": a.lineno, "column": source.start(a)[1] + 1} for a in node.names)
            elif isinstance(node, ast.ImportFrom):
                found = re.compile(r"from\s+").match(source.lines[node.lineno - 1], source.start(node)[1])
                column = found.end() + 1 if found else source.start(node)[1] + 1
                out.append({"level": node.level, "module": node.module, "names": [a.name for a in node.names], **told, "column": column})
            elif isinstance(node, ast.If):
                walk(node.body, local, typing or checking(node.test))
                for _, block in source.clauses(node):
                    walk(block, local, typing)
            else:
                for block in source.blocks(node):
                    walk(block, local or isinstance(node, DEFS), typing)

    walk(source.body, False, False)
    return out


# ---- fingerprints -------------------------------------------------------------------------------------------------

_OFFSET, _PRIME, _U64 = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1
_ID, _NUM, _STR, _NEWLINE, _INDENT, _DEDENT = range(1, 7)
_KINDS = {tokenize.NUMBER: _NUM, tokenize.STRING: _STR, tokenize.NEWLINE: _NEWLINE, tokenize.INDENT: _INDENT, tokenize.DEDENT: _DEDENT,
          token.FSTRING_START: _STR, token.FSTRING_MIDDLE: _STR, token.FSTRING_END: _STR}
_texts: dict[str, int] = {}


def _text_hash(text: str) -> int:
    if text not in _texts:
        h = _OFFSET
        for b in text.encode():
            h = ((h ^ b) * _PRIME) & _U64
        _texts[text] = h | 1 << 63
    return _texts[text]


def symbols(source: Source) -> tuple[list[tuple[int, int]], list[tuple[int, int]], np.ndarray]:
    """Starts, ends and normalised symbols of the file's tokens: identifiers, numbers and strings each become one symbol."""
    starts, ends, out = [], [], []
    for t in source.tokens:
        if t.type in (tokenize.COMMENT, tokenize.NL, tokenize.ENDMARKER):
            continue
        plain = t.type == tokenize.NAME and not keyword.iskeyword(t.string)
        out.append(_ID if plain else _KINDS.get(t.type) or _text_hash(t.string))
        starts.append(t.start)
        ends.append(t.end)
    return starts, ends, np.array(out, np.uint64)


def shingles(syms: np.ndarray, k: int = 4) -> np.ndarray:
    """Distinct hashes of k symbols in a row (of all of fewer), ascending, as int64."""
    if len(syms) == 0:
        return np.zeros(0, np.int64)
    k = min(k, len(syms))
    out = np.full(len(syms) - k + 1, _OFFSET, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = (out ^ syms[j : j + len(out)]) * np.uint64(_PRIME)
    return np.unique(out.view(np.int64))


def clone_units(source: Source, k: int = 4) -> list[dict]:
    starts, ends, syms = symbols(source)
    out = []
    for node in source.functions:
        lo, until = bisect_left(starts, source.start(node)), source.end(node)
        hi = lo
        while hi < len(ends) and ends[hi] <= until:
            hi += 1
        out.append({"name": node.name, "line": source.name_at(node)[0], "statements": statements(source, node.body, True), "shingles": shingles(syms[lo:hi], k).tolist()})
    return out
