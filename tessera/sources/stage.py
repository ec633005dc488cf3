"""The parse stage: files of source to fact tables, in one Arrow pass.

``facts`` gives one row a file with its functions, classes, imports, fingerprints and
findings as arrays; ``tables`` writes that once and explodes it lazily, so a query pays
for the columns it reads. A file that does not parse keeps its row, with ``parse_error``
and empty arrays; so does a null text, which could not be read (``scan`` gives null where a file is no UTF-8).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.operators.store import written
from tessera.sources import files as names
from tessera.sources import ghosts, rules
from tessera.sources import measure as M

_KINDS = {"s": T.StringType(), "n": T.LongType(), "b": T.BooleanType(), "x": T.DoubleType(), "S": T.ArrayType(T.StringType()), "N": T.ArrayType(T.LongType())}



_ORDERED = {
    "functions": "name:s line column loc cyclomatic cognitive max_nesting params arity ncss exits typed_params annotatable_params has_return_annotation:b has_docstring:b docstring_lines "
    "loop_qty comparisons_qty numbers_qty string_literals_qty math_ops_qty variables_qty unique_words_qty",
    "classes": "name:s line column loc methods attributes lcom4 tcc:x lcc:x lcom_star:x wmc rfc is_abstract:b has_docstring:b docstring_lines bases:S coupled:S static_calls:S",
    "imports": "line column top:b level module:s names:S type_checking:b local:b",
    "units": "name:s line statements shingles:N",
    "findings": "line column code:s severity:s message:s",
    "noqa": "line codes:S",
    "defs": "name:s kind:s line column free:b",
    "reads": "key:s line column",
}
_FILE = (
    "path:s loc comment_lines nloc handlers bare broad swallow top_level_code function_code is_test:b is_generated:b "
    "test_functions assertion_free_tests assertions production_functions with_doctest doctest_examples parse_error:s"
)


def _fields(told: str) -> list[T.StructField]:
    return [T.StructField(n, _KINDS[k or "n"]) for n, _, k in (x.partition(":") for x in told.split())]


_LISTS = "refs:S string_words:S keys:S"
SCHEMA = T.StructType([*_fields(_FILE), *_fields(_LISTS), *(T.StructField(n, T.ArrayType(T.StructType(_fields(x)))) for n, x in _ORDERED.items())])


def file_facts(path: str, text: str | None, settings: rules.Settings | names.Config) -> dict:
    unreadable, text = text is None, text or ""
    if isinstance(settings, names.Config):
        settings = settings.settings_of(path, names.is_generated(path, text))
    row: dict = {f.name: [] if isinstance(f.dataType, T.ArrayType) else 0 for f in SCHEMA}
    row |= {"path": path, "loc": M.count_lines(text), "is_test": M.is_test_path(path), "is_generated": names.is_generated(path, text), "parse_error": None}
    if unreadable:
        return row | {"parse_error": "the text can't be read"}
    try:
        source = M.Source(text)
        row |= {
            "comment_lines": len(source.comments), "nloc": M.nloc(source), "top_level_code": M.top_level_code(source),
            "function_code": sum(M.statements(source, f.body, False) for f in source.functions), **M.exception_facts(source), **M.test_facts(source, row["is_test"]),
            "functions": [M.function_facts(source, f) for f in source.functions], "classes": [M.class_facts(source, c) for c in source.classes],
            "imports": M.imports(source), "units": M.clone_units(source), "findings": rules.check(path, source, settings), "noqa": rules.directives(source), **ghosts.scan(source),
        }
    except (SyntaxError, RecursionError) as e:
        row |= {"parse_error": str(e), "findings": rules.check_corrupted(text, settings)}
    row["findings"] = [f for f in row["findings"] if settings.counts(f["code"])]
    return row


def parse(sources: DataFrame, settings: rules.Settings | names.Config | None = None) -> DataFrame:
    """(path, source) rows, of a table or a stream, to one row of facts each; no exchange. A ``Config`` gives each file the settings of its profiles."""
    settings = settings or rules.Settings()
    arrow = to_arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = [file_facts(p, s, settings) for p, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return sources.select("path", F.col("source").cast("string")).mapInArrow(run, SCHEMA)


def facts(sources: DataFrame, settings: rules.Settings | names.Config | None = None) -> DataFrame:
    """One row of facts a file: of rows with one path the one of the smallest text. Only paths are exchanged, and the texts of such rows."""
    rows = sources.select(names.normal_path(F.col("path")).alias("path"), F.col("source").cast("string").alias("source"))
    again = written(rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path"), "repeated-paths")
    if again.isEmpty():
        return parse(rows, settings)
    once = rows.join(again, "path", "left_semi").groupBy("path").agg(F.min("source").alias("source"))
    return parse(rows.join(again, "path", "left_anti").union(once), settings)


@dataclass
class Tables:
    """Fact tables of one written parse."""

    parsed: DataFrame

    @property
    def files(self) -> DataFrame:
        return self.parsed.drop(*_ORDERED, "refs", "string_words", "keys")

    def exploded(self, name: str, at: str) -> DataFrame:
        return self.parsed.select("path", F.posexplode(name).alias(at, "x")).select("path", F.col(at).cast("long").alias(at), "x.*")

    @property
    def functions(self) -> DataFrame:
        return self.exploded("functions", "fn_idx")

    @property
    def classes(self) -> DataFrame:
        return self.exploded("classes", "cls_idx")

    @property
    def imports(self) -> DataFrame:
        return self.exploded("imports", "seq")

    @property
    def units(self) -> DataFrame:
        return self.exploded("units", "fn_idx")

    @property
    def findings(self) -> DataFrame:
        return self.exploded("findings", "emit_seq")

    @property
    def noqa(self) -> DataFrame:
        return self.exploded("noqa", "seq").drop("seq")


def tables(sources: DataFrame, settings: rules.Settings | names.Config | None = None) -> Tables:
    return Tables(written(facts(sources, settings), "facts"))
