"""Edits of source text: which are taken together, and files rewritten by them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.sources import measure as M
from tessera.sources import rules

#: (first character, end, text instead)
Edit = tuple[int, int, str]


def accepted(fixes: Iterable[list[Edit]]) -> list[int]:
    """Numbers of the fixes that are made: in order of their first edit, each that begins where all before it have ended.

    A fix without an edit, or of edits that overlap one another, is never made; one that overlaps an accepted fix is
    left for another run, and what it would have covered stays open to later ones.
    """
    ordered = sorted((min(e[0] for e in edits), number, edits) for number, edits in enumerate(fixes) if edits)
    out, end = [], 0
    for first, number, edits in ordered:
        edits = sorted(edits)
        if first >= end and all(a[1] <= b[0] for a, b in zip(edits, edits[1:], strict=False)):
            end = max(end, max(e[1] for e in edits))
            out.append(number)
    return out


def applied(text: str, fixes: list[list[Edit]]) -> tuple[str, list[int]]:
    """The text with the accepted fixes made, and their numbers; edits beyond the text's end are passed over."""
    taken = accepted(fixes)
    for first, end, instead in sorted((e for i in taken for e in fixes[i]), reverse=True):
        if first <= min(end, len(text)):
            text = text[:first] + instead + text[min(end, len(text)) :]
    return text, taken


def without_comments(text: str | None, kept: Iterable[int] = ()) -> tuple[str | None, int]:
    """The text without the comments that SLP010 reports, but for those on ``kept`` lines, and how many went; a text that does not parse stays."""
    if text is None:
        return None, 0
    mark = "﻿" if text.startswith("﻿") else ""
    try:
        source = M.Source(text)
    except SyntaxError:
        return text, 0
    kept = set(kept)
    cuts = [(a, b, "") for a, b, line in rules.deletions(source) if line not in kept]
    fixed, taken = applied(source.text, [[cut] for cut in cuts])
    # the mark goes with a first line that goes
    return ("" if any(cuts[i][0] == 0 for i in taken) else mark) + fixed, len(taken)


def fixed(sources: DataFrame) -> DataFrame:
    """(path, source, fixed): every file rewritten, and how many findings that fixed; row-local. Suppressed comments stay.

    The rewritten table is for the caller to write where it belongs: a failed write is then one of Spark's, which is tried again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                try:
                    silenced = [d["line"] for d in rules.directives(M.Source(text or "")) if d["codes"] is None or "SLP010" in d["codes"]]
                except SyntaxError:
                    silenced = []
                rows.append(without_comments(text, silenced))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["path", "source", "fixed"])

    return sources.select("path", sources["source"].cast("string").alias("source")).mapInArrow(run, "path string, source string, fixed long")
