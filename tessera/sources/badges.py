"""Badges of a panel row: label, value and colour, as SVG or as endpoint JSON; one each, and one of several with the worst colour."""

from __future__ import annotations

import json
from collections.abc import Iterable
from html import escape

from tessera.functions.columns import TIER_NAMES

#: From good to bad: the endpoint's keyword and the fill.
COLOURS = {"brightgreen": "#4c1", "yellow": "#dfb317", "red": "#e05d44"}
_GOOD, _FAIR, _BAD = COLOURS
#: slug: (label, short label, column of the panel, how the value is shown and scaled, where yellow and red begin; reversed bounds: where yellow and red end)
BADGES = {
    "avg-function-loc": ("avg function LoC", "loc", "function_loc_avg", "{:.0f}", 1, (30, 60)),
    "max-cyclomatic": ("max complexity", "CC", "cyclomatic_max", "{}", 1, (10, 20)),
    "cyclomatic-risk": ("max complexity", "risk", "cyclomatic", None, 1, None),
    "max-cognitive": ("max cognitive", "CoCo", "cognitive_max", "{}", 1, (15, 30)),
    "cognitive-risk": ("max cognitive", "CoCo risk", "cognitive", None, 1, None),
    "max-nesting": ("max nesting", "nesting", "max_nesting_max", "{}", 1, (4, 6)),
    "comment-density": ("comment density", "density", "comment_density", "{:.0f}%", 100, (20, 40)),
    "docstring-coverage": ("docstring coverage", "docs", "docstring_coverage", "{:.0f}%", 100, (80, 50)),
}
_TIER_COLOURS = dict(zip(TIER_NAMES, (_GOOD, _FAIR, _BAD, _BAD), strict=True))


def badge(slug: str, row: dict) -> tuple[str, str, str]:
    """(label, value, colour) of a panel row; a risk has the colour of the worst tier, and ``n/a`` where nothing is counted."""
    label, _, column, shown, scale, bounds = BADGES[slug]
    if bounds is None:
        worst = row[f"{column}_worst"]
        return (label, f"{row[f'{column}_max']} ({worst.replace('_', ' ')})", _TIER_COLOURS[worst]) if worst else (label, "n/a", _GOOD)
    value = row[column] * scale
    yellow, red = bounds
    if yellow > red:
        colour = _GOOD if value >= yellow else _FAIR if value >= red else _BAD
    else:
        colour = _BAD if value >= red else _FAIR if value >= yellow else _GOOD
    return label, shown.format(value), colour


def summary(row: dict, slugs: Iterable[str], name: str = "tessera") -> tuple[str, str, str] | None:
    """The named badges in one, of the worst colour; unknown names are passed over, None where none is known."""
    known = [(BADGES[s][1], *badge(s, row)[1:]) for s in slugs if s in BADGES]
    if not known:
        return None
    order = list(COLOURS)
    return name, " · ".join(f"{short} {value}" for short, value, _ in known), max((c for *_, c in known), key=order.index)


def files(row: dict, include: Iterable[str] | None = None, summarised: Iterable[str] = (), name: str = "tessera") -> dict[str, str]:
    """File names and their texts: an SVG and a JSON for each included badge (None: all), and for the summary if it names any."""
    wanted = [s for s in BADGES if include is None or s in set(include)]
    told = {s: badge(s, row) for s in wanted}
    if whole := summary(row, summarised, name):
        told["summary"] = whole
    return {f"{slug}.{kind}": make(x) for slug, x in told.items() for kind, make in (("svg", svg), ("json", endpoint))}


def endpoint(told: tuple[str, str, str]) -> str:
    return json.dumps({"schemaVersion": 1, "label": told[0], "message": told[1], "color": told[2]}, ensure_ascii=False, separators=(",", ":"))


def svg(told: tuple[str, str, str]) -> str:
    label, value, colour = told
    a, b = 7 * len(label) + 10, 7 * len(value) + 10
    label, value = escape(label), escape(value)
    back = f'<rect width="{a}" height="20" fill="#555"/><rect x="{a}" width="{b}" height="20" fill="{COLOURS[colour]}"/>'
    front = "".join(f'<text x="{x}" y="14">{t}</text>' for x, t in ((a // 2, label), (a + b // 2, value)))
    font = 'fill="#fff" font-family="Verdana,DejaVu Sans,sans-serif" font-size="11" text-anchor="middle"'
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{a + b}" height="20" role="img" aria-label="{label}: {value}">{back}<g {font}>{front}</g></svg>\n'
