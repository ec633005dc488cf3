"""Configuration, discovery, fixes, reports by profile, and graph kernels against plain ones."""

import json

import numpy as np
import pytest

from tessera.operators import graphs, similarity
from tessera.operators import modules as graph
from tessera.plans import clones, lint, panel, reports, source_catalog
from tessera.sources import files, fixes, stage


def copied(name):
    return f"def {name}(rows):\n    out = 0\n    for row in rows:\n        if row > 0:\n            out += row\n        else:\n            continue\n    return out\n\n\n"


def test_configuration(tmp_path):
    text = """
preview = true
ignore = ["SLP09"]
[limits]
file_max_lines = 2
[imports]
extra = ["Own_Dist"]
[security]
extra = ["own_guard"]
[[profiles]]
name = "vendored"
match = ["vendor/**"]
exclude = ["**/kept.py"]
ignore = ["SLP08"]
allow_comments = true
[profiles.limits]
max_identifier_words = 9
[[profiles]]
name = "rest"
default = true
"""
    (tmp_path / files.CONFIG_FILE).write_text(text)
    (tmp_path / "a/b").mkdir(parents=True)
    config = files.find_config(str(tmp_path / "a/b"))
    assert config == files.read_config(text) and not config.enabled("SLP090", False) and config.enabled("SLP250", True) and not config.enabled("X1", False)
    assert [config.profiles_of(p, False) for p in ("vendor/a.py", "vendor/x/kept.py", "a.py")] == [["vendored"], ["rest"], ["rest"]]
    mine, other = config.settings_of("vendor/a.py"), config.settings_of("a.py")
    assert (mine.file_lines, mine.name_words, other.name_words, other.guards) == (2, 9, 4, ("own_guard",)) and mine.comments_allowed and not mine.counts("SLP080") and other.counts("SLP080")
    for wrong in ("other = 1", "[limits]\nother = 1", '[[profiles]]\nname = "a"\nother = 1', "[badges]\nother = 1", "[security]\nallow = []"):
        with pytest.raises(ValueError, match="unknown"):
            files.read_config(wrong)
    assert files.Config().profiles_of("a/tests/b.py", False) == ["tests"] and files.Config().profiles_of("a/x_pb2.py", False) == ["generated"] == files.Config().profiles_of("b.py", True)


def test_profiles_in_the_engine_are_those_of_python(spark):
    config = files.Config()
    rows = [(p, g) for p in ("test_a.py", "a/test_b.py", "a/tests/b/c.py", "test/a.py", "contest/a.py", "x_pb2.py", "a/y_pb2_grpc.py", "conftest.py", "b.py") for g in (False, True)]
    got = {}
    for r in files.file_profiles(spark.createDataFrame([(f"{p}", g) for p, g in rows], "path string, is_generated boolean"), config).collect():
        got.setdefault(r.path, []).append(r.profile)
    want = {}
    for p, g in rows:
        want.setdefault(p, []).extend(config.profiles_of(p, g))
    assert {p: sorted(x) for p, x in got.items()} == {p: sorted(x) for p, x in want.items()}


def test_manifests(tmp_path):
    below = tmp_path / "pkg/deep"
    below.mkdir(parents=True)
    (tmp_path / "requirements.txt").write_text("requests>2\n")
    (tmp_path / "requirements-dev.txt").write_text("PyTest\n-r other\n")
    assert files.find_manifest(str(below)) == {"requests", "pytest"}
    (tmp_path / "pkg/pyproject.toml").write_text("[tool.other]\n")
    assert files.find_manifest(str(below)) is None
    (tmp_path / "pkg/requirements.txt").write_text("numpy\n")
    assert files.find_manifest(str(below)) == {"numpy"}
    (tmp_path / "pkg/pyproject.toml").write_text("[project]\ndependencies = []\n")
    assert files.find_manifest(str(below)) == set() and files.declared("[project", "toml") is None
    assert files.declared('[tool.poetry.dependencies]\npython = "3"\nPillow = "1"\n[tool.poetry.group.dev.dependencies]\nx = "1"\n', "toml") == {"pillow", "x"}


def test_undeclared_imports(spark):
    text = "import os, requests\nimport yaml\nfrom bs4.x import y\nimport setuptools, numpy.core\nfrom . import z\nimport pkg\nimport requests\nimport imp, distutils\nif True:\n    import torch\n"
    facts = stage.tables(spark.createDataFrame([("src/pkg/a.py", text)], "path string, source string"))
    found = lambda *a: [(r.line, r.column) for r in lint.undeclared(facts, *a).orderBy("line", "column").collect()]
    assert found(set()) == [(1, 12), (2, 8), (3, 6), (4, 20), (7, 8)] and found(None) == []
    assert found({"PyYAML", "beautifulsoup4", "Numpy"}, ("Requests",)) == []


def test_discovery(spark, tmp_path):
    for path in ("a.py", "b.txt", "build/c.py", "pkg/__init__.py", "pkg/d.py", "pkg/skip.py", ".hidden/e.py", "venv/lib/f.py", "pkg/keep/skip.py"):
        (tmp_path / "in" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / path).write_text("x = 1\n")
    (tmp_path / "in/.gitignore").write_text("# no\nbuild/\nvenv\n")
    (tmp_path / "in/pkg/.gitignore").write_text("skip.py\n!keep/skip.py\n")
    rows, missing = files.discover(spark, str(tmp_path / "in"), str(tmp_path / "in/build/c.py"), str(tmp_path / "gone"))
    assert sorted(r.path.removeprefix(f"{tmp_path}/in/") for r in rows.collect()) == ["a.py", "build/c.py", "pkg/__init__.py", "pkg/d.py", "pkg/keep/skip.py"] and missing == [str(tmp_path / "gone")]


def test_unreadable_files_are_no_empty_ones(spark, tmp_path):
    (tmp_path / "a.py").write_bytes(b"x = '\xff'\n")
    rows = stage.tables(files.scan(spark, str(tmp_path))).files.collect()
    assert len(rows) == 1 and rows[0].parse_error and rows[0].loc == 0


def test_module_roots(spark):
    paths = ["lib/proj/__init__.py", "lib/proj/a.py", "lib/proj/sub/__init__.py", "lib/proj/sub/b.py", "lib/space/c.py", "top.py", "bare/__init__.py"]
    rows = files.rooted_modules(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    assert {r.path: r.module for r in rows} == {
        "lib/proj/__init__.py": "proj", "lib/proj/a.py": "proj.a", "lib/proj/sub/__init__.py": "proj.sub", "lib/proj/sub/b.py": "proj.sub.b", "lib/space/c.py": "c", "top.py": "top", "bare/__init__.py": "bare",
    }


def test_fixes(spark):
    assert fixes.accepted([[(5, 9, "")], [(0, 6, "")], [(6, 7, "")], [], [(10, 12, ""), (11, 13, "")], [(7, 8, "")]]) == [1, 2, 5]
    assert fixes.applied("abcdef", [[(0, 1, "X"), (4, 5, "")], [(5, 99, "!")]]) == ("Xbcd!", [0, 1])
    cases = {
        "a = 1\n# c\nb = 2\n": "a = 1\nb = 2\n", "def f():\n    # c\n    return 1\n": "def f():\n    return 1\n", "x = 1  # c\n": "x = 1\n", "x = 1\n# c": "x = 1\n",
        "﻿# c\nx = 1\n": "x = 1\n", "﻿x = 1  # c\n": "﻿x = 1\n", "#!/bin/sh\n# noqa\n# TODO(1): x\nx = 1  # noqa: SLP010\n": None, "x = (\n": None, "# c\r\nx = 1\r\n": "x = 1\r\n",
    }
    got = {r.path: r for r in fixes.fixed(spark.createDataFrame([*((t, t) for t in cases), ("none", None)], "path string, source string")).collect()}
    assert all(got[t].source == (t if want is None else want) and got[t].fixed == (want is not None) for t, want in cases.items())
    assert got["none"].source is None


def test_rule_details(spark):
    assert lint.rule_detail("slp010")["name"] == "comment-policy" == lint.rule_detail("Comment-Policy")["name"] and len(json.loads(lint.catalogue_json())) == lint.rule_catalogue(spark).count()
    with pytest.raises(KeyError):
        lint.rule_detail("SLP999")


def test_clones_by_profile(spark):
    project = {"shop.py": copied("one") + copied("two") + "def other(x):\n    while x:\n        x -= 1\n        print(x)\n    return [x]\n", "tests/test_x.py": copied("test_one") + copied("test_two")}
    facts = stage.tables(spark.createDataFrame(sorted(project.items()), "path string, source string"))
    got = {r.profile: (r.pairs, r.in_clones, r.functions, r.largest_cluster, r.ratio) for r in clones.clone_stats(facts.units, files.file_profiles(facts.files, files.Config())).collect()}
    assert got == {"production": (1, 2, 3, 2, pytest.approx(2 / 3)), "tests": (1, 2, 2, 2, 1.0)}
    assert tuple(clones.clone_stats(facts.units).collect()[0]) == (6, 4, 5, 4, 0.8)


def test_reports(spark):
    facts = source_catalog.facts(spark)
    rows, proxies = reports.panels(facts), panel.test_proxies(facts.files)
    told = json.loads(reports.metrics_json(rows, proxies).collect()[0].value)
    assert set(told["profiles"]) == {"production", "tests"} and told["test_proxies"]["assertions"] == 1
    mine = told["profiles"]["production"]
    assert mine["graph"]["edges"] == 5 and mine["graph"]["packages"] == 3 and mine["graph"]["package_edges"] == 2 and mine["clones"]["pairs"] == 1 and mine["concentration"]["largest"] == "proj"
    text = [r.value for r in reports.metrics_text(rows, proxies).collect()]
    assert text[0] == "metrics of production" and any(x.startswith("metrics of tests") for x in text) and text[-1].endswith("not coverage)") and any("1 pairs" in x for x in text)
    marked = [r.value for r in reports.metrics_markdown(rows, proxies).collect()]
    assert marked[0] == "### Metrics" and "#### production" in marked and "| low (to 10) | 7 |" in marked
    lines = [json.loads(r.value) for r in reports.function_lines(facts).collect()]
    assert len(lines) == 9 and len(lines[0]) == 24 and lines[0]["file"] == "proj/a.py" and lines[0]["function"] == "__init__"
    classes = [json.loads(r.value) for r in reports.class_lines(graph.class_panel(facts.classes)).collect()]
    assert [c["class"] for c in classes] == ["Shape", "Round"] and len(classes[0]) == 21
    mods = graph.modules(facts.files)
    packages = [json.loads(r.value) for r in reports.package_lines(graph.packages(mods, graph.module_edges(facts.imports, mods), facts.files, facts.classes)).collect()]
    assert "proj" in [p["package"] for p in packages] and len(packages[0]) == 13


def test_strongly_connected_as_tarjan(spark):
    rng = np.random.default_rng(6)
    pairs = [(f"{a:02}", f"{b:02}") for a, b in rng.integers(0, 40, size=(48, 2)).tolist()] + [("90", "91"), ("91", "92"), ("92", "90"), ("92", "93"), ("93", "94"), ("94", "93")]
    got = {r.node: (r.component, r.size) for r in graphs.strongly_connected(spark.createDataFrame(pairs, "src string, dst string")).collect()}
    want = {n: (g[0], len(g)) for g in graphs.tarjan(sorted({x for p in pairs for x in p}), pairs) for n in g}
    assert got == want and len({c for c, _ in got.values()}) >= 3
    assert graphs.strongly_connected(spark.createDataFrame([], "src string, dst string")).count() == 0


@pytest.mark.parametrize("block", [similarity.BLOCK, 8])
def test_links_against_all_pairs(spark, block):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 40, size=60)
    sets = [sorted({*base.tolist()} - {int(x) for x in rng.choice(base, int(rng.integers(0, 7)), replace=False)}) for _ in range(60)] + [[1], [1, 2], [3]]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len({*sets[i]} & {*sets[j]}) / len({*sets[i]} | {*sets[j]}) >= 0.85}
    rows = similarity.links(spark.createDataFrame(list(enumerate(sets)), "id long, shingles array<long>"), block=block).collect()
    assert len(rows) == len({(r.a, r.b) for r in rows}) and {(r.a, r.b) for r in rows} <= want and len(rows) >= 0.995 * len(want) > 300


@pytest.mark.parametrize("block", [similarity.BLOCK, 8])
def test_lowest_links_of_one_crowd(spark, block):
    """60 sets alike have up to 1770 links; the lowest partners come of no more than one link a set and bucket, and of few in all."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 40, size=60)
    sets = [sorted({*base.tolist()} - {int(x) for x in rng.choice(base, int(rng.integers(0, 5)), replace=False)}) for _ in range(60)]
    units = spark.createDataFrame(list(enumerate(sets)), "id long, shingles array<long>")
    every = {(r.a, r.b): r.similarity for r in similarity.links(units, block=block).collect()}
    few = {(r.a, r.b): r.similarity for r in similarity.links(units, block=block, want="lowest").collect()}
    partner = lambda links: {x: min(sum(p) - x for p in links if x in p) for x in {y for p in links for y in p}}
    assert partner(few) == partner(every) and few.items() <= every.items() and len(every) > 1000
    assert len(few) < len(every) / (4 if block > 8 else 1)


def test_depth_writes_each_node_once_in_a_tree(spark, monkeypatch):
    """the levels of a tree have as many rows as it has nodes, and tables of more than a few rows are broadcast by no join of a fixpoint."""
    from tessera.operators import store

    rows, real = [], store.written

    def spied(df, name):
        table = real(df, name)
        rows.append(table.count())
        return table

    monkeypatch.setattr(store, "written", spied)
    monkeypatch.setattr(graphs, "written", spied)
    tree = spark.createDataFrame([(k, k // 2 if k else None) for k in range(400)], "node long, parent long")
    assert {r.node: r.depth for r in graphs.longest_path(tree).collect()} == {k: k.bit_length() for k in range(400)}
    assert sum(rows) <= 4 * 400
    rng = np.random.default_rng(9)
    rowed = [(n, int(p)) for n in range(60) for p in rng.integers(-5, max(n, 1), 3)] + [(0, None)]
    rowed = [(n, p) for n, p in rowed if p is None or p < n]
    want = {}
    for n in range(60):
        want[n] = max([want[p] + 1 for m, p in rowed if m == n and p in want], default=0)
    assert {r.node: r.depth for r in graphs.longest_path(spark.createDataFrame(rowed, "node long, parent long")).collect()} == want
    monkeypatch.setattr(graphs, "FEW", 10)
    one, two = graphs._kept(spark.range(40), "some")[0], graphs._kept(spark.range(40), "some")[0]
    assert "Broadcast" not in one.join(two, "id")._jdf.queryExecution().executedPlan().toString()
    edges = spark.createDataFrame([(i, i + 1) for i in range(30) if i % 10], "a long, b long")
    assert {r.node: r.component for r in graphs.connected_components(edges).collect()} == {i: i - (i - 1) % 10 for i in range(1, 31)}


def test_links_that_span_one_crowd(spark):
    """components need far fewer links than there are, and come out the same."""
    rng = np.random.default_rng(10)
    sets = []
    for _ in range(2):
        base = rng.integers(0, 1 << 40, size=60).tolist()
        sets += [sorted({*base} - {int(x) for x in rng.choice(base, int(rng.integers(0, 5)), replace=False)}) for _ in range(40)]
    units = spark.createDataFrame(list(enumerate(sets)), "id long, shingles array<long>")
    every, few = (similarity.links(units, want=want).select("a", "b") for want in ("all", "span"))
    parts = [{r.node: r.component for r in graphs.connected_components(x).collect()} for x in (every, few)]
    assert parts[0] == parts[1] and set(parts[0].values()) == {0, 40}
    assert few.count() < every.count() / 3


def test_clones_with_copies_and_repeated_rows_as_sql(spark, tmp_path):
    """F4 (and F1, F3): a text's copies, spaces of several kinds, rows that are there twice, short, empty and null texts."""
    from oracle import assert_same

    from tessera.plans import catalog

    long = " ".join(f"w{i}" for i in range(60))
    texts = [long, long, long + " end", long.replace(" ", "\n\t "), long.upper(), "a\x0bb c d e", "a b c", "", None, "one two three four", "one two three four", long + "\x0b", "x\u00a0y z w v"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, long), (2, long + " end"), (20, long), (20, long)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    for table in ("region nation customer supplier part orders lineitem events embeddings pages benchmark labels conversations").split():
        (tmp_path / f"{table}.parquet").symlink_to(f"/root/testdata/sf0.001/{table}.parquet")
    for name in ("j1_clone_pairs_exact", "j3_lowest_partner", "g5_clone_clusters"):
        assert assert_same(catalog.queries()[name](spark, str(tmp_path)), catalog.oracle_sql()[name], str(tmp_path)) > 7


def test_intermediates_can_be_forgotten(spark):
    from tessera.operators import store

    store.forget(spark)
    table = store.written(spark.range(3), "some")
    assert table.count() == 3 and store.forget(spark) == 1 and store.forget(spark) == 0
