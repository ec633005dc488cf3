"""Lint predicates of one file, as findings (line, column, code, severity, message), and its suppressions.

All rules run in the one pass over a file; which of them count is decided afterwards by
the selection of codes (``tessera.plans.lint``). Lines and columns count from 1, columns
in characters.
"""

from __future__ import annotations

import ast
import re
import tokenize
from collections.abc import Iterator
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from tessera.functions.columns import CODE_SIGNS, STATEMENT_WORDS, STOP_WORDS
from tessera.sources import leaks
from tessera.sources import measure as M

#: code: (name, preview, what it says)
CATALOGUE = {
    "SLP001": ("redundant-comment", True, "a comment that repeats the code beside it"),
    "SLP002": ("redundant-docstring", True, "a docstring that repeats the function's own words"),
    "SLP004": ("comment-tells", True, "deferral, hedging or narration in a comment"),
    "SLP010": ("comment-policy", False, "a comment that is neither a directive nor a ticketed task"),
    "SLP020": ("near-duplicate", False, "a function nearly equal to another"),
    "SLP030": ("defensive-except", False, "a broad handler that does nothing"),
    "SLP040": ("redundant-type-hint", True, "an annotation that restates its literal"),
    "SLP050": ("ascii-only", False, "characters outside ASCII"),
    "SLP060": ("verbose-naming", True, "a name of too many words"),
    "SLP080": ("oversized-file", False, "a file of too many lines"),
    "SLP082": ("deep-nesting", False, "a statement nested too deep"),
    "SLP084": ("deep-data-nesting", True, "a literal nested too deep"),
    "SLP090": ("directory-fanout", False, "a directory of too many files"),
    "SLP120": ("god-class", True, "a class whose methods share nothing"),
    "SLP130": ("dispatch-ladder", True, "an if chain that tests one subject"),
    "SLP180": ("undeclared-import", True, "an import that no manifest declares"),
    "SLP210": ("phantom-guard", True, "a security control that nothing defines"),
    "SLP220": ("corrupted-file", True, "leftovers of a merge or a chat in source"),
    "SLP230": ("mock-data", True, "placeholder data outside tests"),
    "SLP240": ("ghost-definition", True, "a definition that nothing refers to"),
    "SLP250": ("cross-language", True, "an idiom of another language"),
}


@dataclass(frozen=True)
class Settings:
    """Limits of the rules, and what of the text rules is extra."""

    name_words: int = 4
    file_lines: int = 400
    nesting: int = 4
    data_nesting: int = 3
    ladder: int = 3
    overlap: float = 0.5
    prose: float = 0.5
    prose_lines: int = 8
    hedging: tuple[str, ...] = ()
    guards: tuple[str, ...] = ()
    placeholders: tuple[str, ...] = ()
    idioms_allowed: tuple[str, ...] = ()
    class_parts: int = 1
    class_methods: int = 3
    ignored: tuple[str, ...] = ()
    comments_allowed: bool = False

    def counts(self, code: str) -> bool:
        """Not ignored by a profile of the file."""
        return not (self.ignored and code.startswith(self.ignored)) and not (self.comments_allowed and code == "SLP010")


_STOP = frozenset(STOP_WORDS)
_LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)
_DIRECTIVE = re.compile(r"!|(?:pragma|fmt|yapf|isort|type|mypy|pyright|pyre|pylint|ruff):|no(?:qa|sec)(?!\w)|.*coding[:=]", re.I | re.S)
_DEFER = (
    "just a placeholder|placeholder (?:implementation|value|for now|until)|return a placeholder|for now|in production,? this would|in (?:a|the) real world|real-world|"
    "would be implemented|would go here|this would be|in practice you would|not implemented yet|left as an exercise|in a real app|in real code|naive implementation|simplified version"
)
_HEDGE = "hopefully|probably|should work|i (?:think|guess)|not sure if|might (?:need|want)|for simplicity|to keep it simple|(?:adjust|tweak) as needed|your actual|replace this with your|or something|feel free to"
_NARRATES = re.compile(r"(?:this (?:script|module|class|method|function)|we are going to)(?!\w)", re.I)
_STEP = re.compile(r"(?:step|phase|part)(?![A-Za-z0-9]).{0,7}?[0-9:]", re.I | re.S)
_LICENCE = re.compile(r"\(c\)|all rights reserved|licensed under|spdx|copyright", re.I)


def _phrase(alternatives: str) -> re.Pattern:
    return re.compile(rf"(?<![A-Za-z0-9_])(?:{alternatives})(?![A-Za-z0-9_])", re.I)


_DEFER_AT, _HEDGE_AT = _phrase(_DEFER), _phrase(_HEDGE)


def words(text: str) -> set[str]:
    """Lower-cased alphanumeric runs of two bytes or more that are no stop words."""
    return {w for w in re.findall(r"[^\W_]+", text.translate(_LOWER)) if len(w.encode()) >= 2} - _STOP


def overlap(some: set[str], others: set[str]) -> float:
    return len(some & others) / len(some) if some else 0.0


def is_directive(body: str) -> bool:
    return _DIRECTIVE.match(body) is not None


def is_ticketed(body: str) -> bool:
    found = re.match(r"(?:HACK|XXX|FIXME|TODO)\([^)]+\)", body)
    return found is not None


def tell(body: str, hedging: tuple[str, ...] = ()) -> tuple[str, str] | None:
    """(severity, message) of the first kind of tell in a comment."""
    if _LICENCE.search(body):
        return None
    if found := _DEFER_AT.search(body):
        return "error", f"puts work off: {found[0].lower()}"
    if found := _HEDGE_AT.search(body) or (_phrase("|".join(map(re.escape, hedging))).search(body) if hedging else None):
        return "warning", f"hedges: {found[0].lower()}"
    if _STEP.match(body):
        return "warning", "numbers a step"
    signs = body.replace(" ", "")
    if len(signs) >= 4 and not signs.strip("=-*~#_+"):
        return "warning", "divides sections"
    if found := _NARRATES.match(body):
        return "warning", f"narrates: {found[0].lower()}"
    return None


def directives(source: M.Source) -> list[dict]:
    """Suppressions: line, and the codes they name; None silences every code of the line."""
    out = []
    for line, _, text in source.comments:
        found = re.match(r"#+\s*noqa(?!\w)(?::(.*))?", text, re.S)
        if found:
            codes = []
            for word in re.split(r"[\s,]+", (found[1] or "").lstrip(" \t,")):
                if not re.fullmatch("(?=.*[A-Z])(?=.*[0-9])[A-Z0-9]+", word):
                    break
                codes.append(word)
            out.append({"line": line, "codes": codes or None})
    return out


def deletions(source: M.Source) -> list[tuple[int, int, int]]:
    """(first character, end, line) of what goes with each comment that SLP010 reports: its whole line, or with the blanks before it."""
    at, starts = 0, []
    for line in source.lines:
        starts.append(at)
        at += len(line) + 1
    out = []
    for line, col, text in source.comments:
        body = text.lstrip("#").strip()
        if is_directive(body) or is_ticketed(body) or (line == 1 and text.startswith("#!")):
            continue
        before = source.lines[line - 1][:col]
        begin = starts[line - 1] + col
        end = begin + len(text)
        if before.strip():
            out.append((begin - (len(before) - len(before.rstrip(" \t"))), end, line))
        else:
            end += source.text.startswith("\r", end)
            out.append((starts[line - 1], end + source.text.startswith("\n", end), line))
    return out


def _finding(line: int, column: int, code: str, message: str, severity: str = "warning") -> dict:
    return {"line": line, "column": column, "code": code, "severity": severity, "message": message}


def _comments(source: M.Source, s: Settings) -> Iterator[dict]:
    lines = source.lines
    for line, col, text in source.comments:
        body = text.lstrip("#").strip()
        if is_directive(body) or is_ticketed(body):
            continue
        said = words(body)
        if 1 <= len(said) <= 6:
            code = lines[line - 1][:col].strip() or next((x.strip() for x in lines[line:] if x.strip()), "")
            if overlap(said, words(code)) >= s.overlap:
                yield _finding(line, col + 1, "SLP001", "the comment repeats the code")
        if found := tell(body, s.hedging):
            yield _finding(line, col + 1, "SLP004", found[1], found[0])
        if not (line == 1 and text.startswith("#!")):
            yield _finding(line, col + 1, "SLP010", "comments are not kept here")


def _docstrings(source: M.Source, s: Settings) -> Iterator[dict]:
    for f in source.functions:
        doc = M.docstring(f.body)
        if doc is None:
            continue
        said = words(doc.value)
        (a, x), (b, y), (c, z), (d, w) = source.start(f), source.start(doc), source.end(doc), source.end(f)
        text = source.lines
        before = "\n".join([text[a - 1][x:], *text[a : b - 1]]) if a < b else text[a - 1][x:y]
        after = "\n".join([text[c - 1][z:], *text[c : d - 1], text[d - 1][:w]]) if d > c else ""
        if 2 <= len(said) <= 12 and overlap(said, words(before + after)) >= s.overlap:
            yield _finding(b, y + 1, "SLP002", "the docstring repeats the function")


_SIMPLE = {"int": int, "float": float, "complex": complex, "str": str, "bytes": bytes, "bool": bool}


def _is_log(node: ast.stmt) -> bool:
    if not (isinstance(node, ast.Expr) and isinstance(node.value, ast.Call)):
        return False
    f = node.value.func
    if isinstance(f, ast.Name):
        return f.id == "print"
    return isinstance(f, ast.Attribute) and f.attr in ("log", "debug", "info", "warn", "warning", "error", "critical", "exception")


def _ladder(source: M.Source, node: ast.If) -> tuple[int, str] | None:
    tests = [node.test, *(t for t, _ in source.clauses(node) if t is not None)]

    def equal(t: ast.expr) -> str | None:
        return ast.dump(t.left) if isinstance(t, ast.Compare) and len(t.ops) == 1 and isinstance(t.ops[0], ast.Eq) and isinstance(t.comparators[0], ast.Constant) else None

    def instance(t: ast.expr) -> str | None:
        return ast.dump(t.args[0]) if isinstance(t, ast.Call) and isinstance(t.func, ast.Name) and t.func.id == "isinstance" and len(t.args) == 2 else None

    for kind, of in (("literal", equal), ("isinstance", instance)):
        subjects = set(map(of, tests))
        if len(subjects) == 1 and None not in subjects:
            return len(tests), kind
    return None


def _depth(node: ast.AST) -> int:
    kinds = (ast.List, ast.Dict, ast.Tuple, ast.Set, ast.ListComp, ast.DictComp, ast.SetComp)
    below = max((_depth(c) for c in ast.iter_child_nodes(node) if isinstance(c, (*kinds, ast.comprehension, ast.Starred))), default=0)
    return below + isinstance(node, kinds)


def _deep_data(source: M.Source, s: Settings) -> Iterator[dict]:
    kinds = (ast.List, ast.Dict, ast.Tuple, ast.Set, ast.ListComp, ast.DictComp, ast.SetComp)
    todo: list[ast.AST] = [source.tree]
    while todo:
        node = todo.pop()
        if isinstance(node, kinds) and isinstance(getattr(node, "ctx", ast.Load()), ast.Load) and (depth := _depth(node)) > s.data_nesting:
            line, col = source.start(node)
            yield _finding(line, col + 1, "SLP084", f"data nested {depth} deep")
            continue
        todo += ast.iter_child_nodes(node)


def _statements(source: M.Source, s: Settings) -> Iterator[dict]:
    for node in ast.walk(source.tree):
        if isinstance(node, ast.ExceptHandler) and (node.type is None or (isinstance(node.type, ast.Name) and node.type.id in ("Exception", "BaseException"))):
            only = node.body[0]
            again = isinstance(only, ast.Raise) and (only.exc is None or isinstance(only.exc, ast.Name))
            if len(node.body) == 1 and (isinstance(only, ast.Pass) or again or _is_log(only)):
                line, col = source.start(node)
                yield _finding(line, col + 1, "SLP030", "a broad handler that only passes, raises again or logs")
        elif isinstance(node, ast.AnnAssign) and isinstance(node.annotation, ast.Name) and isinstance(node.value, (ast.Constant, ast.JoinedStr)):
            kind = _SIMPLE.get(node.annotation.id)
            literal = str if isinstance(node.value, ast.JoinedStr) else type(node.value.value)
            if kind is literal:
                line, col = source.start(node.annotation)
                yield _finding(line, col + 1, "SLP040", f"{node.annotation.id} restates the literal")
        elif isinstance(node, ast.If) and not source.is_elif(node) and (found := _ladder(source, node)) and found[0] > s.ladder:
            line, col = source.start(node.test)
            yield _finding(line, col + 1, "SLP130", f"{found[0]} {found[1]} tests of one subject")
    for f in source.functions:
        if deep := _first_deep(source, f.body, 0, s.nesting):
            line, col = source.start(deep)
            yield _finding(line, col + 1, "SLP082", f"nested deeper than {s.nesting} in {f.name}")


def _first_deep(source: M.Source, body: list[ast.stmt], depth: int, limit: int) -> ast.stmt | None:
    for node in body:
        if depth > limit:
            return node
        if isinstance(node, (ast.If, *M.LOOPS, *M.WITHS, *M.TRIES)):
            for block in source.blocks(node):
                if found := _first_deep(source, block, depth + 1, limit):
                    return found
    return None


_LOOSE_BASES = frozenset("Protocol ABC ABCMeta Enum IntEnum StrEnum Flag IntFlag TypedDict NamedTuple".split())


def _root(node: ast.expr) -> str | None:
    """The first identifier of a name, attribute, call or subscript."""
    while isinstance(node, (ast.Attribute, ast.Call, ast.Subscript)):
        node = node.func if isinstance(node, ast.Call) else node.value
    return node.id if isinstance(node, ast.Name) else None


def _is_loose(node: ast.ClassDef) -> bool:
    """Classes of data and interfaces, whose methods need share nothing."""
    if any(M.trailing(d) == "dataclass" or _root(d) in ("attr", "attrs") for d in node.decorator_list):
        return True
    return any(M.trailing(b) in _LOOSE_BASES for b in node.bases) or any(k.arg == "metaclass" and M.trailing(k.value) == "ABCMeta" for k in node.keywords)


def _classes(source: M.Source, s: Settings) -> Iterator[dict]:
    for node in source.classes:
        methods = [m for m in node.body if isinstance(m, M.DEFS)]
        counted = [m for m in methods if m.name not in M.CONSTRUCTORS]
        if not _is_loose(node) and len(counted) >= s.class_methods and (n := M.cohesion(methods)[0]) > s.class_parts:
            line, col = source.name_at(node)
            yield _finding(line, col + 1, "SLP120", f"{len(counted)} methods in {n} parts that share nothing")


def _text(source: M.Source, s: Settings) -> Iterator[dict]:
    for number, line in enumerate(source.lines, 1):
        for run in re.finditer(r"[^\x00-\x7f]+", line):
            yield _finding(number, run.start() + 1, "SLP050", f"{len(run[0])} characters outside ASCII")
    seen = set()
    for t in source.tokens:
        if t.type == tokenize.NAME and t.string not in seen:
            seen.add(t.string)
            n = sum(1 + len(re.findall(r"[a-z](?=[A-Z])", part)) for part in t.string.split("_") if part)
            if n > s.name_words:
                yield _finding(t.start[0], t.start[1] + 1, "SLP060", f"{t.string} has {n} words")
    if (n := M.count_lines(source.text)) > s.file_lines:
        yield _finding(1, 1, "SLP080", f"{n} lines; the limit is {s.file_lines}")


_LEFTOVERS = (
    (re.compile("(?:`{3}|~{3})"), "a fence of markdown"), (re.compile(r"(?:<{7}|>{7}|\|{7})"), "a marker of a merge conflict"),
    (re.compile(r"<(?:[A-Za-z].*|/.*[A-Za-z].*)>$", re.S), "a tag on a line of its own"),
)
_SIGN = re.compile(f"[{re.escape(CODE_SIGNS)}]")
_STATEMENT = frozenset(STATEMENT_WORDS)


def _artifact(lines: list[str], skip: set[int]) -> dict | None:
    """The first line that is a leftover; seven = alone may as well underline a title."""
    for number, line in enumerate(lines, 1):
        if number not in skip and (said := next((x for sign, x in _LEFTOVERS if sign.match(line.strip())), None)):
            return _finding(number, 1, "SLP220", said)
    return None


def is_prose(line: str) -> bool:
    found = line.split()
    return len(found) >= 4 and not _SIGN.search(line) and found[0] not in _STATEMENT


def _prose(lines: list[str], skip: set[int], s: Settings) -> dict | None:
    code = [x for number, x in enumerate(lines, 1) if number not in skip and x.strip() and not x.strip().startswith("#")]
    if len(code) >= s.prose_lines and sum(map(is_prose, code)) >= s.prose * len(code):
        return _finding(1, 1, "SLP220", "prose where code should be")
    return None


def check_corrupted(text: str, s: Settings) -> list[dict]:
    """What a file that does not parse is reported for."""
    lines = text.split("\n")
    return [_artifact(lines, set()) or _prose(lines, set(), s) or _finding(1, 1, "SLP220", "it does not parse")]


def check(path: str, source: M.Source, s: Settings) -> list[dict]:
    """Findings in the order comments, texts, statements, classes, leftovers."""
    inside: set[int] = set()
    for t in source.tokens:
        if t.type in (tokenize.STRING, tokenize.COMMENT, tokenize.FSTRING_START, tokenize.FSTRING_MIDDLE, tokenize.FSTRING_END):
            inside.update(range(t.start[0], t.end[0] + 1))
    told = (("SLP210", leaks.phantom_guards(source, s.guards)), ("SLP230", leaks.placeholders(path, source, s.placeholders)), ("SLP250", leaks.foreign_idioms(source, s.idioms_allowed)))
    leaked = [_finding(line, column, code, said) for code, found in told for line, column, said in found]
    leftovers = [x for x in (_artifact(source.lines, inside), _prose(source.lines, inside, s)) if x]
    return [*_comments(source, s), *_docstrings(source, s), *_text(source, s), *_statements(source, s), *_deep_data(source, s), *_classes(source, s), *leaked, *leftovers]
