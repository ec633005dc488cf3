"""What a file defines, refers to and reads from configuration: the facts behind definitions that nothing refers to."""

from __future__ import annotations

import ast
import re

from tessera.sources.measure import DEFS, Source, name_of

_UPPER = re.compile(r"(?=.*[A-Z])[A-Z0-9_]{2,}")
_BASE = re.compile(r".+(?:Meta|Protocol|Interface|Mixin|ABC|Base)")
_ENTRY = frozenset(("app", "application", "cli", "create_app", "get_application", "handler", "lambda_handler", "main", "run", "setup", "teardown"))
_SETTINGS = frozenset(("app_config", "app_settings", "cfg", "conf", "config", "feature_flags", "features", "flags", "options", "opts", "settings"))


def scan(source: Source) -> dict:
    """defs (name, kind, line, column, free) and reads (key, line, column) as rows; refs, string_words (exports are strings too) and keys as sorted lists.

    A definition is ``free`` if nothing about itself says that it may stay unreferenced.
    """
    defs, reads, keys = [], [], set()
    refs: set[str] = set()
    words: set[str] = set()
    for node in source.body:
        if isinstance(node, (*DEFS, ast.ClassDef)):
            kept = bool(node.decorator_list) or node.name.startswith(("test_", "Test")) or (node.name.startswith("__") and node.name.endswith("__")) or node.name in _ENTRY
            if isinstance(node, ast.ClassDef):
                bases = {name_of(b.value if isinstance(b, ast.Subscript) else b) for b in node.bases}
                kept = kept or _BASE.fullmatch(node.name) is not None or not bases.isdisjoint(("ABC", "ABCMeta", "Protocol"))
            line, col = source.name_at(node)
            defs.append({"name": node.name, "kind": "class" if isinstance(node, ast.ClassDef) else "function", "line": line, "column": col + 1, "free": not kept})
    for node in ast.walk(source.tree):
        if isinstance(node, ast.Import):
            refs.update(a.asname or a.name.split(".")[0] for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            refs.update(a.asname or a.name for a in node.names)
        elif isinstance(node, ast.Constant) and isinstance(node.value, str):
            words.update(re.findall(r"[A-Za-z0-9_]+", node.value))
        elif isinstance(node, (ast.Name, ast.Attribute)):
            name = name_of(node)
            refs.add(name)
            if _UPPER.fullmatch(name):
                if isinstance(node.ctx, ast.Store):
                    keys.add(name)
                elif isinstance(node, ast.Attribute) and isinstance(node.ctx, ast.Load) and isinstance(node.value, ast.Name) and node.value.id.lower() in _SETTINGS:
                    line, col = source.start(node)
                    reads.append({"key": name, "line": line, "column": col + 1})
    return {"defs": defs, "refs": sorted(refs), "string_words": sorted(words), "keys": sorted(keys), "reads": reads}
