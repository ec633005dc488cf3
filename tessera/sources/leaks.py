"""What generated code leaves in a file: guards that nothing defines, placeholder data, idioms of other languages.

Each check gives (line, column, message), by place, one a place.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from tessera.sources import measure as M

Found = Iterator[tuple[int, int, str]]

# ---- guards -------------------------------------------------------------------------------------------------------

#: Names of security controls, by their first word.
GUARDS = frozenset(
    "_".join(x for x in (verb, rest) if x != "-")
    for verb, rests in {
        "validate": "api_key csrf email input jwt password request signature token user", "verify": "api_key credentials csrf jwt password signature token user",
        "check": "access api_key auth credentials csrf password permission permissions rate_limit signature token", "sanitize": "- html input user_input",
        "require": "api_key auth https login permission role", "requires": "auth login permission role", "ensure": "authenticated authorized csrf permission",
        "escape": "html input sql string", "authenticate": "- request user", "authorize": "- request", "has": "permission role", "is": "authenticated authorized safe_url",
        "rate": "limit limited", "clean": "input", "csrf": "protect", "decode": "jwt", "enforce": "https", "hash": "password", "html": "escape", "login": "required",
        "permission": "required", "prevent": "sql_injection", "secure": "filename", "strip": "tags", "throttle": "-", "xss": "clean",
    }.items()
    for rest in rests.split()
)


def within_one_edit(a: str, b: str) -> bool:
    """At most one insertion, deletion or substitution apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


def bound_names(tree: ast.AST) -> set[str]:
    """Every name that any scope of a file binds."""
    out: set[str] = set()
    for node in ast.walk(tree):
        if isinstance(node, (*M.DEFS, ast.ClassDef)):
            out.add(node.name)
        elif isinstance(node, ast.arg):
            out.add(node.arg)
        elif isinstance(node, ast.Import):
            out.update(a.asname or a.name.partition(".")[0] for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            out.update(a.asname or a.name for a in node.names)
        elif isinstance(node, (ast.Global, ast.Nonlocal)):
            out.update(node.names)
        elif isinstance(node, ast.Name) and isinstance(node.ctx, ast.Store):
            out.add(node.id)
        elif isinstance(node, ast.ExceptHandler) and node.name:
            out.add(node.name)
    return out


def phantom_guards(source: M.Source, extra: tuple[str, ...] = ()) -> Found:
    """Calls and decorators of a security control's name that the file binds nowhere."""
    bound, found = bound_names(source.tree), {}
    for node in ast.walk(source.tree):
        marks = [(d.func if isinstance(d, ast.Call) else d, "decorator") for d in getattr(node, "decorator_list", ())]
        if isinstance(node, ast.Call):
            marks.append((node.func, "call"))
        for name, kind in marks:
            if isinstance(name, ast.Name) and name.id not in bound and (name.id in GUARDS or name.id in extra):
                at = source.start(name)
                if kind == "decorator" or at not in found:
                    found[at] = kind, name.id
    for (line, col), (kind, name) in sorted(found.items()):
        near = min((x for x in bound if within_one_edit(name, x)), default=None)
        yield line, col + 1, f"{kind} of {name}, which nothing here defines" + (f"; did you mean {near}?" if near else "")


# ---- placeholders -------------------------------------------------------------------------------------------------

_DOMAINS = re.compile(r"(?:(?:domain|mycompany|your(?:company|domain))\.com|example\.(?:org|net|com)|.*\.(?:localhost|invalid|example|test))")
_PHONES = "000-000-0000 555-0123 555-0100 123-4567 1234567890 123.456.7890".split() + ["(123) 456-7890", "123-456-7890"]
_CREDENTIAL = re.compile(r".*(?:passw(?:or)?d|pwd|secret|token|api_?key|(?:access|private|auth)_key|credential)", re.S)
_WEAK = re.compile(
    r"(?:123456(?:78)?|admin|api_?key|change_me|dummy|example|foo(?:bar)?|letmein|(?:my|top)?secret|passwd|password\d*|pwd|qwerty|root|test(?:123|ing|_api_key)?|token"
    r"|your[_-].*|changeme.*|.*placeholder.*|(.)\1{2,})",
    re.S,
)
_UNFINISHED = frozenset("todo tbd fixme placeholder example dummy changeme foo bar baz".split()) | {"foo bar"}
_TOKENS = frozenset("value key placeholder foo example baz bar".split())
_TEST_FILE = re.compile(r"(?:^|/)(?:conftest\.py|test_[^/]*\.py|[^/]*_test\.py)$|(?:^|/)tests(?:/|$)")


def is_placeholder_uuid(text: str) -> bool:
    """The shape of a UUID, of no more than two different digits."""
    return re.fullmatch(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", text, re.A) is not None and len(set(text.lower()) - {"-"}) <= 2


def is_placeholder_phone(text: str) -> bool:
    """Holds a well-known fake number, or is the shape of a number of one digit only."""
    if any(p in text for p in _PHONES):
        return True
    digits = re.sub(r"[ .()+-]", "", text)
    return re.fullmatch(r"([0-9])\1*", digits) is not None and len(digits) in (7, 10, 11)


def placeholder_domain(text: str) -> str | None:
    """The domain of an address if it is reserved for examples or stands for one's own."""
    _, at, rest = text.partition("@")
    domain = re.match(r"[A-Za-z0-9.-]*", rest)[0].lower() if at else ""
    return domain if domain and _DOMAINS.fullmatch(domain) else None


def is_weak_credential(text: str, extra: tuple[str, ...] = ()) -> bool:
    low = text.strip().lower()
    return _WEAK.fullmatch(low) is not None or low in {e.lower() for e in extra}


def _text(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _quoted(text: str) -> str:
    return f'"{text[:32]}…"' if len(text) > 32 else f'"{text}"'


def _unfinished(value: ast.expr | None, extra: tuple[str, ...]) -> str | None:
    text = _text(value)
    if text is not None and (text.strip().lower() in _UNFINISHED or text.strip().lower() in {e.lower() for e in extra}):
        return f"returns the placeholder {_quoted(text)}"
    if isinstance(value, ast.Dict) and 1 <= len(value.keys) <= 3 and all((_text(x) or "").strip().lower() in _TOKENS for x in (*value.keys, *value.values)):
        return "returns a dictionary of placeholders"
    return None


def placeholders(path: str, source: M.Source, extra: tuple[str, ...] = ()) -> Found:
    """Placeholder credentials, returns, addresses, numbers and identifiers outside tests and docstrings."""
    if _TEST_FILE.search(path.replace("\\", "/")):
        return
    found: dict[tuple[int, int], str] = {}

    def credential(name: str | None, value: ast.expr | None) -> None:
        text = _text(value)
        if name and text is not None and _CREDENTIAL.fullmatch(name.lower()) and is_weak_credential(text, extra):
            found.setdefault(source.start(value), f"{name} is the placeholder {_quoted(text)}")

    documents = [M.docstring(x.body) for x in (source.tree, *source.functions, *source.classes)]
    spared = {source.start(d) for d in documents if d}
    for node in ast.walk(source.tree):
        if isinstance(node, (ast.Assign, ast.AnnAssign)):
            for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                credential(target.id if isinstance(target, ast.Name) else None, node.value)
        elif isinstance(node, ast.Call):
            for keyword in node.keywords:
                credential(keyword.arg, keyword.value)
        elif isinstance(node, ast.Return) and (said := _unfinished(node.value, extra)):
            found.setdefault(source.start(node.value), said)
    # pieces of f-strings are no literals of their own
    inside = {id(x) for node in ast.walk(source.tree) if isinstance(node, ast.JoinedStr) for x in node.values}
    for node in ast.walk(source.tree):
        text = _text(node)
        if text is None or id(node) in inside or (at := source.start(node)) in spared:
            continue
        text = text.strip()
        if domain := placeholder_domain(text):
            found.setdefault(at, f"an address at the placeholder {domain}")
        elif is_placeholder_uuid(text):
            found.setdefault(at, "a placeholder for a UUID")
        elif is_placeholder_phone(text):
            found.setdefault(at, "a placeholder for a telephone number")
    for (line, col), said in sorted(found.items()):
        yield line, col + 1, said


# ---- other languages ----------------------------------------------------------------------------------------------

#: What Python has instead: of methods, attributes and functions.
_METHODS = {
    **dict.fromkeys(("charCodeAt", "codePointAt"), "ord"), **dict.fromkeys(("substring", "substr"), "a slice"), **dict.fromkeys(("toUpperCase", "toLocaleUpperCase"), "upper"),
    **dict.fromkeys(("toLowerCase", "toLocaleLowerCase"), "lower"), **dict.fromkeys(("getElementById", "querySelector", "addEventListener"), "a library for it"),
    "toString": "str", "valueOf": "the value itself", "hashCode": "hash", "getClass": "type", "charAt": "an index", "indexOf": "find", "lastIndexOf": "rfind", "forEach": "a loop",
    "parseInt": "int", "parseFloat": "float", "toFixed": "a format", "splice": "slice assignment", "unshift": "insert", "padStart": "rjust", "padEnd": "ljust",
    "trimStart": "lstrip", "trimEnd": "rstrip", "toLocaleString": "a format",
}
_ATTRIBUTES = {"length": "len", "prototype": "a class", "__proto__": "type"}
_FUNCTIONS = {
    **dict.fromkeys(("println", "printf", "puts"), "print"), **dict.fromkeys(("var_dump", "var_export"), "repr"), "print_r": "pprint", "sprintf": "an f-string", "strlen": "len",
    "array_push": "append", "array_pop": "pop", "array_merge": "+ or |", "array_keys": "keys", "array_values": "values", "array_map": "a comprehension",
    "array_filter": "a comprehension", "in_array": "in", "is_array": "isinstance", "json_encode": "json.dumps", "json_decode": "json.loads", "str_replace": "replace", "strpos": "find",
}
#: Bindings whose own names are in that style.
_CAMEL = re.compile(r"(?:PyQt[456]|PySide[26]?|qtpy)(?:\.|$)")


def foreign_idioms(source: M.Source, allowed: tuple[str, ...] = ()) -> Found:
    """Methods, attributes and functions of JavaScript, Java, PHP, C or Ruby; none in files that import a Qt binding."""
    for node in source.body:
        names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
        if any(map(_CAMEL.match, names)):
            return
    found: dict[tuple[int, int], tuple[str, str]] = {}

    def record(node: ast.expr, name: str, known: dict[str, str]) -> None:
        if name in known and name not in allowed:
            line, end = source.end(node)
            found.setdefault((line, end - len(name)), (name, known[name]))

    for node in ast.walk(source.tree):
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
            record(node.func, node.func.attr, _METHODS)
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            record(node.func, node.func.id, _FUNCTIONS)
        elif isinstance(node, ast.Attribute) and isinstance(node.ctx, ast.Load):
            record(node, node.attr, _ATTRIBUTES)
    for (line, col), (name, instead) in sorted(found.items()):
        yield line, col + 1, f"{name} is of another language; Python has {instead}"
