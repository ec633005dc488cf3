"""Sinks of the metrics: one panel a profile as text, JSON and markdown; functions, classes and packages as lines of JSON.

A panel has one row a profile, so what is gathered into one document is bounded by the number of profiles; the
feeds by function, class and package stay tables of lines, to be written by as many tasks as there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import columns as X
from tessera.operators import modules as graph
from tessera.operators import relations
from tessera.operators.store import written
from tessera.plans import clones, panel
from tessera.sources import files as names
from tessera.sources.stage import Tables

_FUNCTION = (
    "loc ncss cyclomatic cognitive max_nesting params arity exits typed_params annotatable_params has_return_annotation has_docstring docstring_lines loop_qty comparisons_qty "
    "numbers_qty string_literals_qty math_ops_qty variables_qty unique_words_qty"
).split()
_CLASS = "loc methods attributes lcom4 tcc lcc lcom_star wmc dit noc cbo fan_out fan_in cbo_modified nosi rfc is_abstract has_docstring docstring_lines".split()
_PACKAGE = "package modules loc imports imported_by ce ca instability in_cycle classes abstract_classes abstractness distance".split()


def _lines(rows: DataFrame, fields: list[Column | str]) -> DataFrame:
    return rows.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def function_lines(facts: Tables) -> DataFrame:
    """A line of JSON a function, with the length and comment density of its file."""
    of = facts.files.select("path", F.col("loc").alias("file_loc"), X.ratio(F.col("comment_lines"), F.col("loc")).alias("file_comment_density"))
    rows = facts.functions.join(of, "path").orderBy("path", "fn_idx")
    return _lines(rows, [F.col("path").alias("file"), F.col("name").alias("function"), *_FUNCTION, "file_loc", "file_comment_density"])


def class_lines(classes: DataFrame) -> DataFrame:
    """A line of JSON a class of a class panel."""
    return _lines(classes.orderBy("path", "cls_idx"), [F.col("path").alias("file"), F.col("name").alias("class"), *_CLASS])


def package_lines(packages: DataFrame) -> DataFrame:
    """A line of JSON a package, by name."""
    return _lines(packages.orderBy("package"), list(_PACKAGE))


def panels(facts: Tables, config: names.Config | None = None) -> DataFrame:
    """One row a profile: the panel with ``graph``, ``concentration`` and ``clones`` of its files alone."""
    config = config or names.Config()
    profiles = written(names.file_profiles(facts.files, config), "profiles")
    rows = panel.panel(facts.files, facts.functions, graph.class_panel(facts.classes), profiles)
    by = ("profile",)
    mods = written(graph.modules(facts.files.join(profiles, "path"), by), "profile-modules")
    edges = graph.module_edges(facts.imports.join(profiles, "path"), mods, by)
    graphs = graph.graph_panel(mods, edges, by)
    graphs = graphs.select("profile", F.struct(*[c for c in graphs.columns if c != "profile"]).alias("graph"))
    sizes = mods.groupBy("profile", "package").agg(F.count("*").alias("n"))
    piled = relations.concentration_by(sizes, "profile", "package", "n")
    copied = clones.clone_stats(facts.units, profiles, config.clone["min_statements"], config.clone["similarity"])
    copied = copied.select("profile", F.struct(*[c for c in copied.columns if c != "profile"]).alias("clones"))
    return rows.join(graphs, "profile", "left").join(piled, "profile", "left").join(copied, "profile", "left")


def metrics_json(rows: DataFrame, proxies: DataFrame) -> DataFrame:
    """One document: every profile's panel by name, and the test proxies of all files."""
    fields = [c for c in rows.columns if c != "profile"]
    each = rows.agg(F.array_sort(F.collect_list(F.struct("profile", F.struct(*fields).alias("panel")))).alias("p"))
    told = each.join(proxies.select(F.struct("*").alias("test_proxies")), how="cross")
    return told.select(F.to_json(F.struct(F.map_from_entries("p").alias("profiles"), "test_proxies"), {"ignoreNullFields": "false"}).alias("value"))


_KINDS = (("cyclomatic", "cyclomatic complexity", "functions"), ("cognitive", "cognitive complexity", "functions"), ("arity", "parameters", "functions"), ("wmc", "class weight", "classes"),
          ("noc", "subclasses", "classes"), ("cbo", "class coupling", "classes"), ("rfc", "class response", "classes"), ("nloc", "module size", "modules"))


def _share(c: str) -> Column:
    return F.coalesce(F.format_number(c, 2), F.lit("n/a"))


def _bands(kind: str) -> list[Column]:
    return [F.coalesce(F.col(f"{kind}_tiers.{t}"), F.lit(0)) for t in X.TIER_NAMES]


def _spread(kind: str) -> list[Column]:
    return [F.format_number(f"{kind}_avg", 1), F.col(f"{kind}_p95"), F.col(f"{kind}_max")]


def metrics_text(rows: DataFrame, proxies: DataFrame) -> DataFrame:
    """A block of lines a profile, then the test proxies once."""
    percent = lambda c: F.format_number(100 * F.col(c), 1)
    told: list[Column] = [
        F.format_string("metrics of %s", "profile"), F.format_string("  files               %d", "files"), F.format_string("  functions           %d", "functions"),
        F.format_string("  lines               %d", "loc"), F.format_string("  function lines      %s mean, %d most, %d most of logic", F.format_number("function_loc_avg", 1), "function_loc_max", "max_logic_function_loc"),
    ]
    for kind, said, _ in _KINDS:
        told.append(F.format_string(f"  {said:<22}%s mean, %d p95, %d most; %d low, %d moderate, %d high, %d very high", *_spread(kind), *_bands(kind)))
    told += [
        F.format_string("  deepest nesting     %d", "max_nesting_max"), F.format_string("  comments            %s%% of lines", percent("comment_density")),
        F.format_string("  documented          %s%%, %s lines a statement", percent("docstring_coverage"), F.format_number("docstring_code_ratio", 2)),
        F.format_string("  annotated           %s%%", percent("annotation_coverage")),
        F.format_string("  handlers            %d: %d broad, %d silent, %d bare", "handlers", "broad", "swallow", "bare"), F.format_string("  classes             %d", "classes"),
        F.format_string("  top-level code      %s%% mean, %s%% most, %d files not decomposed", percent("top_level_ratio_avg"), percent("top_level_ratio_max"), "undecomposed_files"),
        F.format_string("  very high units     %d: %d cyclomatic, %d cognitive, %d classes, %d modules", "god_units", "god_cyclomatic", "god_cognitive", "god_wmc", "god_nloc"),
        F.format_string("  largest package     %s of %d modules, share %s, Gini %s over %d", F.coalesce("concentration.largest", F.lit("n/a")), F.coalesce("concentration.total", F.lit(0)),
                        _share("concentration.max_share"), _share("concentration.gini"), F.coalesce("concentration.groups", F.lit(0))),
        F.format_string("  clones              %s of functions: %d of %d; %d pairs, largest cluster %d", _share("clones.ratio"), *(F.coalesce(f"clones.{c}", F.lit(0)) for c in ("in_clones", "functions", "pairs", "largest_cluster"))),
    ]
    body = rows.select(F.lit(0).alias("part"), "profile", F.posexplode(F.array(*told)).alias("at", "value"))
    tail = proxies.select(F.lit(1), F.lit(""), F.posexplode(F.array(*_proxies())))
    return body.union(tail).orderBy("part", "profile", "at").select("value")


def _proxies() -> list[Column]:
    return [
        F.format_string("  test to code        %s: %d to %d lines", _share("test_code_ratio"), "test_loc", "production_loc"),
        F.format_string("  assertions a test   %s: %d in %d", _share("assertion_density"), "assertions", "test_functions"),
        F.format_string("  tests without any   %s: %d of %d", _share("assertion_free_rate"), "assertion_free_tests", "test_functions"),
        F.format_string("  doctested           %s: %d of %d functions, %d examples", _share("doctest_coverage"), "with_doctest", "production_functions", "doctest_examples"),
        F.lit("  (static estimates, not coverage)"),
    ]


def metrics_markdown(rows: DataFrame, proxies: DataFrame) -> DataFrame:
    """A section a profile with a table for each kind of unit, clones, and the test proxies once."""
    told: list[Column] = [F.format_string("#### %s", "profile"), F.lit("")]
    for kind, said, units in _KINDS:
        low, moderate, high = X.TIERS[kind]
        names_of = (f"low (to {low})", f"moderate (to {moderate})", f"high (to {high})", f"very high (over {high})")
        worst = F.coalesce(F.replace(F.col(f"{kind}_worst"), F.lit("_"), F.lit(" ")), F.lit("n/a"))
        told.append(F.format_string(f"**{said.capitalize()}**: mean %s, p95 %d, most %d (worst tier: %s)", *_spread(kind), worst))
        told += [F.lit(""), F.lit(f"| tier | {units} |"), F.lit("| --- | ---: |"), *(F.format_string(f"| {n} | %d |", c) for n, c in zip(names_of, _bands(kind), strict=True)), F.lit("")]
    told.append(F.format_string("**Handlers**: %d, of which %s broad and %s silent", "handlers", _share("broad_rate"), _share("swallow_rate")))
    told.append(F.format_string("**Clones**: ratio %s, %d pairs, largest cluster %d", _share("clones.ratio"), *(F.coalesce(f"clones.{c}", F.lit(0)) for c in ("pairs", "largest_cluster"))))
    body = rows.select(F.lit(1).alias("part"), "profile", F.posexplode(F.array(*told)).alias("at", "value"))
    head = rows.sparkSession.createDataFrame([(0, "", 0, "### Metrics"), (0, "", 1, "")], "part int, profile string, at int, value string")
    tail = proxies.select(F.lit(2), F.lit(""), F.posexplode(F.array(F.lit(""), F.lit("**Test proxies**"), *(F.concat(F.lit("- "), F.ltrim(c)) for c in _proxies()))))
    return head.union(body).union(tail).orderBy("part", "profile", "at").select("value")
