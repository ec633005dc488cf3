"""Per-file measures on small sources with values worked out by hand, and the tables made of them."""

import json

import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from tessera.functions import columns as X
from tessera.operators import graphs, relations
from tessera.plans import clones, lint, panel, source_catalog
from tessera.sources import badges, files, leaks, rules, stage
from tessera.sources import measure as M


def functions(text):
    source = M.Source(text)
    return {f.name: M.function_facts(source, f) for f in source.functions}


@pytest.mark.parametrize("name", sorted(source_catalog.oracle_sql()))
def test_project(spark, name):
    assert assert_same(source_catalog.queries()[name](spark, ""), source_catalog.oracle_sql()[name], "/root/testdata/sf0.001")


def test_nested_functions_are_their_own():
    got = functions("def outer():\n    def inner(x):\n        while x:\n            x -= 1\n        return x\n    return inner if outer else None\n")
    assert (got["outer"]["cyclomatic"], got["outer"]["loop_qty"], got["outer"]["ncss"], got["outer"]["cognitive"]) == (2, 0, 2, 1)
    assert (got["inner"]["cyclomatic"], got["inner"]["loop_qty"], got["inner"]["max_nesting"]) == (2, 1, 1)


def test_cognitive_of_elif_else_and_nested_if():
    assert functions("def f(a, b):\n    if a:\n        pass\n    elif b and a or b:\n        pass\n    else:\n        if b:\n            pass\n")["f"]["cognitive"] == 1 + 1 + 2 + 1 + 2
    assert functions("def f(a):\n    match a:\n        case 1 if a:\n            pass\n        case _:\n            pass\n")["f"]["cyclomatic"] == 4
    assert functions("async def f(a):\n    async for x in a:\n        async with x:\n            yield x\n")["f"]["max_nesting"] == 2


def test_decorators_receivers_and_annotations():
    got = functions("class A:\n    @property\n    # why\n    def p(self, /, a: int, *, b=1, **k) -> int: ...\n    @staticmethod\n    def s(self, x): ...\n")
    assert (got["p"]["loc"], got["p"]["line"], got["p"]["column"], got["p"]["params"], got["p"]["arity"], got["p"]["typed_params"], got["p"]["annotatable_params"]) == (3, 4, 9, 4, 3, 1, 2)
    assert got["s"]["arity"] == 2


def test_strings_of_f_strings_count_once():
    got = functions("def f(x):\n    'doc'\n    y = f'a{x}b' + 'c' + b'd'.decode()\n    return -1 < x < 2.5 or True\n")["f"]
    assert (got["string_literals_qty"], got["math_ops_qty"], got["numbers_qty"], got["comparisons_qty"], got["docstring_lines"]) == (3, 2, 2, 2, 1)


def test_cohesion():
    source = M.Source("class A:\n    def __init__(self):\n        self.a = 1\n    def f(self):\n        return self.a\n    def g(self):\n        return self.a + self.b\n    def h(self):\n        return self.b\n")
    got = M.class_facts(source, source.classes[0])
    assert (got["methods"], got["attributes"], got["lcom4"], got["tcc"], got["lcc"], got["lcom_star"]) == (4, 2, 1, pytest.approx(2 / 3), 1.0, 0.5)


def test_file_measures():
    source = M.Source('"""Doc."""\nimport os\n\nLIMIT = (1, -2)\nfor i in os.listdir():\n    print(i)\n\nif __name__ == "__main__":\n    print()\n')
    assert (M.top_level_code(source), M.nloc(source), M.count_lines(source.text)) == (2, 7, 9)
    assert [M.count_lines(x) for x in ("", "a", "a\n", "a\n\n", "\x0c\u2028")] == [0, 1, 1, 2, 1]
    caught = M.exception_facts(M.Source("try:\n    pass\nexcept (ValueError, builtins.Exception):\n    ...\nexcept KeyError:\n    print()\nexcept:\n    pass\n"))
    assert caught == {"handlers": 3, "bare": 1, "broad": 1, "swallow": 2}
    with pytest.raises(SyntaxError):
        M.Source("def f(:\n")


def test_test_facts():
    text = "class TestA:\n    def test_x(self):\n        self.assertEqual(1, 1)\n        with pytest.raises(E):\n            assert f()\n    def testing(self): ...\ndef test(): ...\ndef helper():\n    def test_inner(): ...\n"
    assert M.test_facts(M.Source(text), True) | {} == {"test_functions": 2, "assertion_free_tests": 1, "assertions": 3, "production_functions": 0, "with_doctest": 0, "doctest_examples": 0}
    assert [M.is_test_path(p) for p in ("tests/a.py", "a/test_b.py", "b_test.py", "conftest.py", "contest.py", "attest/a.py")] == [True, True, True, True, False, False]


def test_rules():
    text = "i = 0  # i is zero\nx = 1  # noqa: E501, SLP010 because\n# for now this is enough\n# Step 2: go on\n# TODO(7): later\n# type: ignore\nnaïve: str = 'é'\n"
    source = M.Source(text)
    got = {(f["line"], f["column"], f["code"], f["severity"]) for f in rules.check("a.py", source, rules.Settings())}
    assert {(3, 1, "SLP004", "error"), (4, 1, "SLP004", "warning"), (7, 3, "SLP050", "warning"), (7, 15, "SLP050", "warning"), (7, 8, "SLP040", "warning")} <= got
    assert {line for line, _, code, _ in got if code == "SLP010"} == {1, 3, 4}
    assert rules.directives(source) == [{"line": 2, "codes": ["E501", "SLP010"]}]
    ladder = "if x == 1:\n    pass\nelif x == 2:\n    pass\nelif x == 3:\n    pass\nelif x == 4:\n    pass\n"
    assert [f["code"] for f in rules.check("a.py", M.Source(ladder), rules.Settings())] == ["SLP130"]
    assert [f["message"] for f in rules.check_corrupted("<<<<<<< one\nx\n", rules.Settings())] == ["a marker of a merge conflict"]


def test_module_names(spark):
    paths = ["src/a/b.py", "a/__init__.py", "__init__.py", "top.py", "a/b.txt"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select("path", files.module_of(F.col("path")).alias("m")).collect()
    assert [r.m for r in rows] == ["a.b", "a", None, "top", None]


def test_requirements():
    assert [files.requirement(x) for x in ("Py_YAML>=5 ; x", "-r other", "# no", "git+https://x#egg=My.Pkg", "a[b]~=1", "https://x/y")] == ["py-yaml", None, None, "my-pkg", "a", None]
    assert files.declared('[project]\ndependencies = ["requests>2"]\n[dependency-groups]\ndev = ["pytest"]\n', "toml") == {"requests", "pytest"}
    with pytest.raises(ValueError):
        files.read_config("unheard = 1")


def test_edges_of_the_stage(spark):
    rows = [("a.py", None), ("b.py", ""), ("./b.py", ""), ("c.py", "def f(:"), ("d_pb2.py", "x = 1\n"), ("e.py", "# DO NOT EDIT\n"), ("f.py", "x = 1\n" * 60_000)]
    t = stage.tables(spark.createDataFrame(rows, "path string, source string"))
    got = {r.path: r for r in t.files.collect()}
    assert len(got) == 6 and got["c.py"].parse_error and got["f.py"].loc == 60_000 and got["d_pb2.py"].is_generated and got["e.py"].is_generated and not got["b.py"].is_generated
    empty = stage.tables(spark.createDataFrame([], "path string, source string"))
    assert empty.files.count() == 0 and clones.clone_stats(empty.units).collect()[0].pairs == 0
    assert panel.test_proxies(empty.files).collect()[0].test_code_ratio is None


def test_sinks(spark):
    config = files.Config(preview=True, ignore=("SLP002", "SLP120", "SLP240"))
    rows = lint.findings(source_catalog.facts(spark), config, {"requests"})
    assert len(json.loads(lint.json_document(rows).collect()[0].value)["findings"]) == 6
    assert json.loads(lint.sarif(rows).collect()[0].value)["version"] == "2.1.0"
    assert lint.agent_lines(rows).count() == 6 and lint.text_lines(rows.limit(0)).collect()[0].value == "No diagnostics."
    assert [r.value for r in lint.markdown(rows).collect()][-1] == "| **total** | 6 |"


def test_copied_functions_are_not_expanded(spark):
    body = "def f{0}(a):\n    b = a + {0}\n    c = b * 2\n    return c\n\n\n"
    t = stage.tables(spark.createDataFrame([("m.py", "".join(body.format(i) for i in range(40)))], "path string, source string"))
    row = clones.clone_stats(t.units).collect()[0]
    assert (row.pairs, row.in_clones, row.largest_cluster) == (40 * 39 // 2, 40, 40)
    got = {r.name: r.partner_name for r in clones.clone_findings(t.units).collect()}
    assert got["f0"] == "f1" and got["f39"] == "f0"


def test_ghosts(spark):
    project = {
        "a.py": "import settings\n\ndef used(): ...\ndef ghost(): ...\ndef main(): ...\n@register\ndef kept(): ...\nclass ThingBase: ...\ndef named(): ...\n__all__ = ['Listed']\nclass Listed: ...\nif settings.DEBUG or settings.MISSING: ...\n",
        "b.py": "from a import used\nDEBUG = 1\nx = 'the named one'\n", "tests/c.py": "def helper(): ...\n",
    }
    rows = lint.ghosts(stage.tables(spark.createDataFrame(list(project.items()), "path string, source string"))).collect()
    assert {(r.path, r.line, r.column, r.message) for r in rows} == {("a.py", 4, 5, "nothing refers to function ghost"), ("a.py", 12, 22, "nothing defines the setting MISSING")}
    bare = stage.tables(spark.createDataFrame([("a.py", "import config\nconfig.GONE\n")], "path string, source string"))
    assert lint.ghosts(bare).count() == 0


def test_kernels(spark):
    values = spark.createDataFrame([(v,) for v in range(1, 21)], "x long")
    assert values.agg(X.nearest_rank("x").alias("p")).collect()[0].p == 19
    assert values.limit(0).agg(X.nearest_rank("x").alias("p")).collect()[0].p == 0
    gini = relations.concentration(spark.createDataFrame([("a", 1), ("b", 3)], "g string, n long"), "g", "n").collect()[0]
    assert (gini.gini, gini.largest) == (pytest.approx(0.25), "b")
    triangles = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "f"), ("f", "d"), ("c", "d")]
    weights = graphs.symmetric_weights(list("abcdef"), triangles)
    assert graphs.modularity(weights, [0, 0, 0, 1, 1, 1]) == pytest.approx(5 / 14) and len(set(graphs.detected_communities(6, weights))) == 2
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    assert graphs.propagation_cost(nodes, edges).collect()[0].propagation_cost == pytest.approx(6 / 9)


def test_stream(spark, tmp_path):
    from tessera.streaming import check

    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.json").write_text(json.dumps({"path": "a.py", "source": "# for now\n"}) + "\n")
    stream = spark.readStream.schema("path string, source string").json(str(tmp_path / "in"))
    query = check.findings(stream).writeStream.format("memory").queryName("seen").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "at")).start()
    query.awaitTermination(60)
    assert {r.code for r in spark.table("seen").collect()} == {"SLP004", "SLP010"}


def codes(text, path="a.py", **settings):
    return [(f["line"], f["column"], f["code"]) for f in rules.check(path, M.Source(text), rules.Settings(**settings))]


def test_badges():
    row = {"function_loc_avg": 29.6, "cyclomatic_max": 27, "cyclomatic_worst": "high", "cognitive_max": 0, "cognitive_worst": None, "max_nesting_max": 4, "comment_density": 0.41, "docstring_coverage": 0.8}
    told = {slug: badges.badge(slug, row)[1:] for slug in badges.BADGES}
    assert told == {
        "avg-function-loc": ("30", "brightgreen"), "max-cyclomatic": ("27", "red"), "cyclomatic-risk": ("27 (high)", "red"), "max-cognitive": ("0", "brightgreen"),
        "cognitive-risk": ("n/a", "brightgreen"), "max-nesting": ("4", "yellow"), "comment-density": ("41%", "red"), "docstring-coverage": ("80%", "brightgreen"),
    }
    assert badges.summary(row, ["max-nesting", "nothing", "docstring-coverage"]) == ("tessera", "nesting 4 · docs 80%", "yellow")
    assert badges.summary(row, ["nothing"]) is None
    assert set(badges.files(row, ["max-nesting"], ["max-cyclomatic"])) == {"max-nesting.svg", "max-nesting.json", "summary.svg", "summary.json"}
    assert 'aria-label="a&lt;b: &quot;"' in badges.svg(("a<b", '"', "red")) and json.loads(badges.endpoint(('a"b', "\\", "red")))["label"] == 'a"b'


def test_suppressions():
    def told(comment):
        return rules.directives(M.Source(f"x = 1  {comment}\n"))

    everything, nothing = [{"line": 1, "codes": None}], []
    assert [told(f"# {x}") for x in ("noqa", "noqa: ", "noqa (why)", "noqa : X12", "noqa: why X12", "noqa: x12")] == [everything] * 6
    assert [told(f"# {x}") for x in ("NOQA", "noqaX", "noqa_", "no qa", "see noqa")] == [nothing] * 5
    assert told("#noqa:A1,B22  because C3")[0]["codes"] == ["A1", "B22"] and told("# noqa: AB1C2")[0]["codes"] == ["AB1C2"]


def test_leftovers():
    def said(text):
        return [f["message"].split()[1] for f in rules.check_corrupted(text, rules.Settings())]

    assert [said(x + "\n(") for x in ("```python", "    ~~~", "<<<<<<< HEAD", ">>>>>>>", "||||||| base", '<file path="a.py">', "</source>")] == [["fence"]] * 2 + [["marker"]] * 3 + [["tag"]] * 2
    assert [said(x + "\n(") for x in ("=======", "x < y > z", "<>", "<=>", "</1>")] == [["does"]] * 5
    prose = "Here is how the parser was put together\nIt reads one incoming token at a time\nEvery stage checks its own inputs first\nThe rest follows from that quite directly\n" * 2
    assert rules.check_corrupted(prose, rules.Settings())[0]["message"].startswith("prose")
    asserts = "def test():\n" + "".join(f"    assert field{i} is not None\n" for i in range(9))
    assert [c for *_, c in codes(asserts) if c == "SLP220"] == []
    assert [c for *_, c in codes('def f():\n    """Such:\n\n    ```\n    f()\n    ```\n    """\n') if c == "SLP220"] == []
    assert rules.check_corrupted("```\n", rules.Settings())[0]["severity"] == "warning"


def test_words_steps_logs_and_loose_classes():
    assert rules.words("Was THE compute_totalÉ a of") == {"compute", "totalÉ"}
    assert [rules.tell(x) is not None for x in ("Step: go", "step-1", "Step one", "stepwise 1", "Phase 2", "part of it all 3", "steps 1")] == [True, True, False, False, True, False, False]
    log = "try:\n    f()\nexcept Exception as e:\n    {}\n"
    assert [[c for *_, c in codes(log.format(x))] for x in ("LOG.error(e)", "self.audit.log(e)", "print(e)", "save(e)", "raise")] == [["SLP030"]] * 3 + [[]] + [["SLP030"]]
    body = "    def f(self):\n        return self.a\n    def g(self):\n        return self.b\n    def h(self):\n        return self.c\n"
    tight = ("@dataclass(frozen=True)\nclass A:\n", "@attr.s\nclass A:\n", "class A(typing.Protocol[T]):\n", "class A(metaclass=abc.ABCMeta):\n", "class A(Enum):\n")
    loose = ("@define\nclass A:\n", "@frozen\nclass A:\n", "class A(BaseModel):\n", "class A(TestCase):\n", "class A:\n")
    assert [[c for *_, c in codes(x + body)] for x in (*tight, *loose)] == [[]] * 5 + [["SLP120"]] * 5


def test_phantom_guards():
    text = "@requires_auth\ndef a(): ...\n@rate_limit(5)\ndef b(): validate_token(x)\n@app.login_required\ndef c(): self.sanitize(x)\n"
    assert codes(text) == [(1, 2, "SLP210"), (3, 2, "SLP210"), (4, 10, "SLP210")]
    for bound in ("from m import validate_token\n", "def validate_token(x): ...\n", "class validate_token: ...\n", "validate_token = 1\n", "f = lambda validate_token: 1\n", "import validate_token.x\n", "def f():\n    global validate_token\n"):
        assert codes(bound + "validate_token(y)\n") == []
    near = rules.check("a.py", M.Source("def validate_tokn(x): ...\nvalidate_token(1)\nown_guard(2)\n"), rules.Settings(guards=("own_guard",)))
    assert [f["message"] for f in near] == ["call of validate_token, which nothing here defines; did you mean validate_tokn?", "call of own_guard, which nothing here defines"]
    within = leaks.within_one_edit
    assert [within(a, b) for a, b in (("abc", "abd"), ("abc", "ab"), ("ab", "xab"), ("abc", "abc"), ("abc", "acb"), ("a", "abc"), ("abcd", "abxy"), ("", "a"))] == [True] * 4 + [False] * 3 + [True]
    assert len(leaks.GUARDS) == 76


def test_placeholders():
    text = 'def f():\n    """Write to me@example.com."""\n    return {"mail": "user@example.com", "tel": "123-456-7890"}\n'
    found = {path: [c for c in codes(text, path) if c[2] == "SLP230"] for path in ("a.py", "a/tests/b.py", "test_x.py", "conftest.py", "a/test/b.py")}
    assert found["a.py"] == found["a/test/b.py"] == [(3, 21, "SLP230"), (3, 48, "SLP230")] and not any(found[p] for p in ("a/tests/b.py", "test_x.py", "conftest.py"))
    for line, hit in {
        'password = "changeme"': 1, 'db_password: str = "Password123"': 1, 'connect(api_key="your-key")': 1, 'token = "xxxx"': 1, 'token_pattern = "secret"': 0, 'password = "gT7#kq"': 0,
        'x = "00000000-0000-0000-0000-000000000000"': 1, 'x = "550e8400-e29b-41d4-a716-446655440000"': 0, 'x = "111-111-1111"': 1, 'x = "800-800-8000"': 0, 'x = "ann@foo.com"': 0,
        'x = "ann@shop.test"': 1, 'def g():\n    return "TODO"': 1, 'def g():\n    return {"foo": "bar"}': 1, 'def g():\n    return {"value": x}': 0, 'def g():\n    return {}': 0, 'x = f"a@example.com{y}"': 0,
    }.items():
        assert len([c for *_, c in codes(line + "\n") if c == "SLP230"]) == hit, line
    assert codes('secret = "Ours"\n', placeholders=("ours",)) == [(1, 10, "SLP230")]


def test_foreign_idioms():
    assert codes("a = x.toString()\nb = x.length\nx.length = 3\nprintln(a)\ny.push(1)\nconsole.log(a)\n") == [(1, 7, "SLP250"), (2, 7, "SLP250"), (4, 1, "SLP250")]
    assert codes("from PyQt5.QtCore import QUrl\na = x.toString()\n") == [] and codes("x.length\n", idioms_allowed=("length",)) == []
    assert codes("a = (x\n     .charAt)(1)\n") == [(2, 7, "SLP250")]


def test_payloads(spark):
    from tessera.streaming import check

    rows = [('{"tool_input": {"file_path": "a.py"}, "file_path": "c.py"}',), ('{"file_path": "b.py"}',), ("{}",), ("no json",), (None,)]
    got = spark.createDataFrame(rows, "p string").select(check.payload_path(F.col("p")).alias("f")).collect()
    assert [r.f for r in got] == ["a.py", "b.py", None, None, None]
