"""Queries over parsed source. The tables at hand hold no Python, so these run on a small project of their own.

Their SQL is the expected rows, worked out by hand: it proves agreement with those values
and nothing more. They take the session and ignore the folder of tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import modules as graph
from tessera.plans import clones, lint, panel, reports
from tessera.sources import badges, fixes, stage
from tessera.sources.files import Config, file_profiles, rooted_modules

PROJECT = {
    "proj/__init__.py": "",
    "proj/a.py": '''"""Shapes."""
from . import b


class Shape:
    def __init__(self, size):
        self.size = size

    def area(self) -> int:
        """How much it covers."""
        return self.size * self.size

    def name(self):
        return "shape"


class Round(Shape):
    def turn(self, other: Shape, by: int = 1):
        for step in range(by):
            if step and other.size:
                Shape.area(other)
        return [x for x in (1, 2) if x]
''',
    "proj/b.py": '''import proj.a
from .sub import helper


def total(items, rate):
    out = 0
    for item in items:
        if item > 0:
            out += item * rate
        elif item < -5:
            out -= 1
        else:
            continue
    return out


def combined(rows, share):
    acc = 0
    for row in rows:
        if row > 0:
            acc += row * share
        elif row < -7:
            acc -= 2
        else:
            continue
    return acc
''',
    "proj/c.py": "from proj.a import Shape\nimport numpy\n\nLIMIT = 5\n\n\ndef load():\n    try:\n        return numpy.ones(LIMIT)\n    except Exception:\n        pass\n",
    "proj/sub/__init__.py": "",
    "proj/sub/helper.py": "from proj import a\n\nx = 1  # set x to one\ny = 2  # noqa\nz: int = 3  # TODO(12) later\n",
    "tests/test_b.py": '''from proj.b import total


def test_total():
    assert total([1, 2], 2) == 6


def test_nothing():
    total([], 1)
''',
    "top.py": "print('hello')\n",
}
_queries: dict[str, Callable] = {}
_sql: dict[str, str] = {}


def _expect(columns: str, rows: str) -> Callable:
    def register(f: Callable) -> Callable:
        _queries[f.__name__] = f
        _sql[f.__name__] = f"SELECT * FROM (VALUES {rows}) t({columns})"
        return f

    return register


def facts(spark: SparkSession) -> stage.Tables:
    return stage.tables(spark.createDataFrame(sorted(PROJECT.items()), "path string, source string"))


@_expect(
    "path, name, loc, cyclomatic, cognitive, max_nesting, arity, ncss, exits, variables_qty",
    "('proj/a.py','__init__',2,1,0,0,1,1,0,0), ('proj/a.py','area',3,1,0,0,0,2,1,0), ('proj/a.py','name',2,1,0,0,0,1,1,0), ('proj/a.py','turn',5,6,5,2,2,4,1,2), "
    "('proj/b.py','total',10,4,5,2,2,7,1,2), ('proj/b.py','combined',10,4,5,2,2,7,1,2), ('proj/c.py','load',5,2,1,1,0,3,1,0), "
    "('tests/test_b.py','test_total',2,1,0,0,0,1,0,0), ('tests/test_b.py','test_nothing',2,1,0,0,0,1,0,0)",
)
def fx_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark).functions.select("path", "name", "loc", "cyclomatic", "cognitive", "max_nesting", "arity", "ncss", "exits", "variables_qty")


@_expect(
    "name, methods, attributes, lcom4, wmc, rfc, dit, noc, cbo, fan_in, cbo_modified, nosi",
    "('Shape',3,1,2,3,3,0,1,0,1,1,0), ('Round',1,0,1,6,3,1,0,1,0,1,1)",
)
def fx_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("name", "methods", "attributes", "lcom4", "wmc", "rfc", "dit", "noc", "cbo", "fan_in", "cbo_modified", "nosi")
    return graph.class_panel(facts(spark).classes).select(*names)


def _production(spark: SparkSession) -> tuple[stage.Tables, DataFrame, DataFrame]:
    t = facts(spark)
    mods = graph.modules(t.files.where("not is_test"))
    return t, mods, graph.module_edges(t.imports, mods)


@_expect("src, dst, runtime", "('proj.a','proj.b',true), ('proj.b','proj.a',true), ('proj.b','proj.sub.helper',true), ('proj.c','proj.a',true), ('proj.sub.helper','proj.a',true)")
def fx_module_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _production(spark)[2].select("src", "dst", "runtime")


@_expect(
    "modules, tangle, runtime_tangles, load_bearing_tangles, in_cycles, propagation_cost, q_declared, q_detected",
    "(7,'proj.a,proj.b,proj.sub.helper',1,1,3,round(16/49.0::DOUBLE,9),-0.08::DOUBLE,0.0::DOUBLE)",
)
def fx_module_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, mods, edges = _production(spark)
    rounded = [F.round(c, 9).alias(c) for c in ("propagation_cost", "q_declared", "q_detected")]
    row = graph.graph_panel(mods, edges)
    return row.select("modules", F.array_join(F.col("tangles")[0], ",").alias("tangle"), "runtime_tangles", "load_bearing_tangles", "in_cycles", *rounded)


@_expect(
    "package, modules, ce, ca, instability, abstractness, distance, in_cycle",
    "('.',1,0,0,0.0::DOUBLE,0.0::DOUBLE,1.0::DOUBLE,false), ('proj',4,1,1,0.5::DOUBLE,0.0::DOUBLE,0.5::DOUBLE,true), ('proj.sub',2,1,1,0.5::DOUBLE,0.0::DOUBLE,0.5::DOUBLE,true)",
)
def fx_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, mods, edges = _production(spark)
    return graph.packages(mods, edges, t.files, t.classes).select("package", "modules", "ce", "ca", "instability", "abstractness", "distance", "in_cycle")


@_expect("pairs, in_clones, functions, largest_cluster, ratio", "(1,2,9,2,round(2/9.0::DOUBLE,9))")
def fx_clone_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clones.clone_stats(facts(spark).units).withColumn("ratio", F.round("ratio", 9))


@_expect(
    'path, line, "column", code',
    "('proj/b.py',5,1,'SLP020'), ('proj/b.py',17,1,'SLP020'), ('proj/c.py',2,8,'SLP180'), ('proj/c.py',10,5,'SLP030'), ('proj/sub/helper.py',3,8,'SLP010'), ('proj/sub/helper.py',5,4,'SLP040')",
)
def fx_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = Config(preview=True, ignore=("SLP002", "SLP120", "SLP240"))
    return lint.findings(facts(spark), config, {"requests"}).select("path", "line", "column", "code")


@_expect(
    "path, line, message",
    "('proj/a.py',17,'nothing refers to class Round'), ('proj/b.py',17,'nothing refers to function combined'), ('proj/c.py',7,'nothing refers to function load')",
)
def fx_ghosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.ghosts(facts(spark)).select("path", "line", "message")


@_expect(
    "profile, files, functions, cyclomatic_p95, cyclomatic_max, cognitive_max, classes, broad_rate, docstring_coverage, annotation_coverage",
    "('production',7,7,6,6,5,2,1.0::DOUBLE,round(1/8.0::DOUBLE,9),round(2/7.0::DOUBLE,9)), ('tests',1,2,1,1,0,0,0.0::DOUBLE,0.0::DOUBLE,0.0::DOUBLE)",
)
def fx_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = facts(spark)
    rows = panel.panel(t.files, t.functions, graph.class_panel(t.classes), file_profiles(t.files, Config()))
    rounded = [F.round(c, 9).alias(c) for c in ("broad_rate", "docstring_coverage", "annotation_coverage")]
    return rows.select("profile", "files", "functions", "cyclomatic_p95", "cyclomatic_max", "cognitive_max", "classes", *rounded)


@_expect(
    "test_files, production_files, test_functions, assertions, assertion_free_tests, production_functions, assertion_density, doctest_coverage",
    "(1,7,2,1,1,7,0.5::DOUBLE,0.0::DOUBLE)",
)
def fx_test_proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("test_files", "production_files", "test_functions", "assertions", "assertion_free_tests", "production_functions", "assertion_density", "doctest_coverage")
    return panel.test_proxies(facts(spark).files).select(*names)


#: A second project, of what generated code leaves behind.
LEFT = {
    "app/__init__.py": "",
    "app/auth.py": '''import yaml
import requests, app
from os import path


@requires_auth
def remove(user):
    validate_token(user.token)
    sanitise = user.name.toString()
    return "TODO"


def connect(host):
    return host.open(password="changeme", mail="admin@example.com", size=host.names.length)


# was for the step before
class Loose:
    def a(self):
        return self.x

    def b(self):
        return self.y

    def c(self):
        return self.z
''',
    "app/broken.py": "```python\nx = (\n",
    "tests/test_auth.py": '''import pytest


def test_one():
    a = "user@example.com"
    b = a.upper()
    assert b == a  # noqa: SLP010
    # gone


def test_two():
    c = "user@example.com"
    d = c.upper()
    assert d == c
''',
}


def _left(spark: SparkSession) -> stage.Tables:
    return stage.tables(spark.createDataFrame(sorted(LEFT.items()), "path string, source string"))


@_expect(
    'path, line, "column", code',
    "('app/auth.py',6,2,'SLP210'), ('app/auth.py',8,5,'SLP210'), ('app/auth.py',9,26,'SLP250'), ('app/auth.py',10,12,'SLP230'), ('app/auth.py',14,31,'SLP230'), "
    "('app/auth.py',14,48,'SLP230'), ('app/auth.py',14,85,'SLP250'), ('app/auth.py',18,7,'SLP120'), ('app/broken.py',1,1,'SLP220')",
)
def fx_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = Config(preview=True, select=("SLP12", "SLP21", "SLP22", "SLP23", "SLP25"))
    return lint.findings(_left(spark), config).select("path", "line", "column", "code")


@_expect('path, line, "column", message', "('app/auth.py',2,8,'requests is not declared'), ('tests/test_auth.py',1,8,'pytest is not declared')")
def fx_undeclared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a manifest that declares PyYAML alone."""
    return lint.undeclared(_left(spark), {"PyYAML"}).select("path", "line", "column", "message")


@_expect("profile, pairs, in_clones, functions, largest_cluster", "('production',0,0,5,0), ('tests',1,2,2,2)")
def fx_profile_clones(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _left(spark)
    return clones.clone_stats(t.units, file_profiles(t.files, Config())).select("profile", "pairs", "in_clones", "functions", "largest_cluster")


@_expect("path, fixed, lines", "('app/__init__.py',0,1), ('app/auth.py',1,26), ('app/broken.py',0,3), ('tests/test_auth.py',1,14)")
def fx_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixes.fixed(spark.createDataFrame(sorted(LEFT.items()), "path string, source string"))
    return rows.select("path", "fixed", F.size(F.split("source", "\n")).cast("long").alias("lines"))


@_expect("line, codes", "(1,'all'), (2,'SLP010,E501'), (3,'all'), (4,'all')")
def fx_suppressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "a = 1  # noqa\nb = 2  # noqa: SLP010, E501 for now\nc = 3  # noqa : X1\nd = 4  # noqa: e501\ne = 5  # NOQA\nf = 6  # noqaX\n"
    rows = stage.tables(spark.createDataFrame([("a.py", text)], "path string, source string")).noqa
    return rows.select("line", F.coalesce(F.array_join("codes", ","), F.lit("all")).alias("codes"))


@_expect("path, module", "('app/__init__.py','app'), ('app/auth.py','app.auth'), ('app/broken.py','app.broken'), ('tests/test_auth.py','test_auth')")
def fx_module_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rooted_modules(spark.createDataFrame([(p,) for p in LEFT], "path string"))


@_expect("slug, message, colour", "('max-cyclomatic','6','brightgreen'), ('cyclomatic-risk','6 (low)','brightgreen'), ('max-nesting','2','brightgreen'), ('docstring-coverage','12%','red')")
def fx_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = facts(spark)
    row = panel.panel(t.files, t.functions, graph.class_panel(t.classes), file_profiles(t.files, Config())).where("profile = 'production'").first().asDict()
    told = [(slug, *badges.badge(slug, row)[1:]) for slug in ("max-cyclomatic", "cyclomatic-risk", "max-nesting", "docstring-coverage")]
    return spark.createDataFrame(told, "slug string, message string, colour string")


@_expect("profile, modules, edges, packages, clone_pairs, largest", "('production',7,5,3,1,'proj'), ('tests',1,0,1,0,'tests')")
def fx_profile_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.panels(facts(spark))
    return rows.select("profile", "graph.modules", "graph.edges", "graph.packages", F.col("clones.pairs").alias("clone_pairs"), "concentration.largest")


@_expect("n, keys, file_loc", "(9,24,22)")
def fx_function_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions in the feed, fields of a line, and the length of the first one's file."""
    rows = reports.function_lines(facts(spark)).withColumn("j", F.from_json("value", "map<string,string>"))
    first = F.min_by(F.col("j")["file_loc"], F.concat(F.col("j")["file"], F.col("j")["function"])).cast("long")
    return rows.agg(F.count("*").alias("n"), F.max(F.size("j")).cast("long").alias("keys"), first.alias("file_loc"))


#: A third project: one function, one class and one module of which every count is small.
COUNTED = {
    "f.py": '''def f(a, b=1, *c):
    """Doc."""
    for x in c:
        if a < x <= 2:
            a = a + 3 * x
    return [y for y in "ab" if y != 'c']
''',
    "c.py": '''from abc import ABC, abstractmethod


class A:
    def __init__(self):
        self.a = 1

    def f(self):
        return self.a

    def g(self):
        return self.a + self.b

    def h(self):
        return self.b


class B(ABC):
    @abstractmethod
    def f(self): ...
''',
    "m.py": '''# Why.
"""Doc."""
import os

LIMIT = (1, -2)
for i in os.listdir():
    print(i)

if __name__ == "__main__":
    print()
''',
}


def _counted(spark: SparkSession) -> stage.Tables:
    return stage.tables(spark.createDataFrame(sorted(COUNTED.items()), "path string, source string"))


@_expect("name, params, arity, loop_qty, comparisons_qty, numbers_qty, string_literals_qty, math_ops_qty", "('f',3,3,2,3,2,3,2)")
def fx_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("name", "params", "arity", "loop_qty", "comparisons_qty", "numbers_qty", "string_literals_qty", "math_ops_qty")
    return _counted(spark).functions.where("path = 'f.py'").select(*names)


@_expect("name, methods, attributes, lcom4, tcc, lcc, lcom_star, is_abstract", "('A',4,2,1,round(2/3.0::DOUBLE,9),1.0::DOUBLE,0.5::DOUBLE,false), ('B',1,0,1,0.0::DOUBLE,0.0::DOUBLE,0.0::DOUBLE,true)")
def fx_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = [F.round(c, 9).alias(c) for c in ("tcc", "lcc", "lcom_star")]
    return _counted(spark).classes.select("name", "methods", "attributes", "lcom4", *rounded, "is_abstract")


@_expect("path, loc, comment_lines, nloc, top_level_code, function_code", "('m.py',10,1,7,2,0), ('f.py',6,0,6,0,5)")
def fx_file_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark).files.where("path in ('m.py', 'f.py')").select("path", "loc", "comment_lines", "nloc", "top_level_code", "function_code")


@_expect("files, comment_density, top_level_ratio_avg, top_level_ratio_max, undecomposed_files, god_units, max_logic_function_loc, function_loc_max", "(1,0.1::DOUBLE,1.0::DOUBLE,1.0::DOUBLE,0,0,0,0)")
def fx_panel_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stage.tables(spark.createDataFrame([("m.py", COUNTED["m.py"])], "path string, source string"))
    row = panel.panel(t.files, t.functions, graph.class_panel(t.classes), file_profiles(t.files, Config()))
    whole = [F.col(c).cast("long").alias(c) for c in ("undecomposed_files", "god_units", "max_logic_function_loc", "function_loc_max")]
    return row.select("files", "comment_density", "top_level_ratio_avg", "top_level_ratio_max", *whole)


@_expect("code, n", "('SLP010',1), ('SLP020',2), ('SLP030',1), ('SLP040',1), ('SLP180',1)")
def fx_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.by_code(lint.findings(facts(spark), Config(preview=True, ignore=("SLP002", "SLP120", "SLP240")), {"requests"}))


@_expect(
    "sink, value",
    "('agent','app/broken.py:1:1: SLP220 a fence of markdown'), ('text','app/broken.py: 1:1 SLP220 [warning] a fence of markdown'), "
    "('json','{\"findings\":[{\"path\":\"app/broken.py\",\"code\":\"SLP220\",\"message\":\"a fence of markdown\",\"severity\":\"warning\",\"line\":1,\"column\":1}]}'), "
    "('markdown','| code | findings |'), ('markdown','| --- | ---: |'), ('markdown','| SLP220 | 1 |'), ('markdown','| **total** | 1 |')",
)
def fx_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lint.findings(_left(spark), Config(preview=True, select=("SLP22",)))
    sinks = (("agent", lint.agent_lines), ("text", lint.text_lines), ("json", lint.json_document), ("markdown", lint.markdown))
    told = [make(rows).select(F.lit(name).alias("sink"), "value") for name, make in sinks]
    return told[0].union(told[1]).union(told[2]).union(told[3])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
