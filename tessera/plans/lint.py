"""Findings of a body of source: rules of single files and of the whole, selection, suppression, and their sinks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import columns as X
from tessera.operators import relations
from tessera.plans import clones
from tessera.sources import files as names
from tessera.sources.files import Config
from tessera.sources.rules import CATALOGUE
from tessera.sources.stage import Tables
from tessera.sources.stdlib import NAMES as STANDARD

FANOUT = 15
#: Distributions of modules that have another name.
ALIASES = {
    "python-{}": "dateutil docx dotenv jose magic pptx slugify", "py{}": "jwt nacl serial usb yaml zmq",
    "attrs": "attr", "beautifulsoup4": "bs4", "grpcio": "grpc", "matplotlib": "mpl_toolkits", "opencv-python": "cv2", "pillow": "PIL", "psycopg2-binary": "psycopg2",
    "pycrypto": "Crypto", "pycryptodome": "Crypto", "pycryptodomex": "Cryptodome", "pymongo": "bson gridfs", "pymupdf": "fitz", "pyopenssl": "OpenSSL", "scikit-image": "skimage",
    "scikit-learn": "sklearn",
}
#: What every environment has without anyone's declaring it.
ALWAYS = ("_distutils_hack", "pip", "pkg_resources", "setuptools", "wheel")
_COLUMNS = ("path", "line", "column", "code", "severity", "message")


def _as_findings(rows: DataFrame, code: str, message: Column, column: Column | int = 1) -> DataFrame:
    return rows.select("path", F.col("line").cast("long").alias("line"), (F.lit(column) if isinstance(column, int) else column).cast("long").alias("column"), F.lit(code).alias("code"), F.lit("warning").alias("severity"), message.alias("message"))


def near_duplicates(facts: Tables, config: Config | None = None) -> DataFrame:
    told = (config or Config()).clone
    return _as_findings(clones.clone_findings(facts.units, told["min_statements"], told["similarity"]), "SLP020", F.format_string("%s is %d%% like %s in %s", "name", "percent", "partner_name", "partner_path"))


def crowded(facts: Tables, limit: int = FANOUT) -> DataFrame:
    rows = relations.crowded_directories(facts.files, limit).select(F.col("first_file").alias("path"), F.lit(1).alias("line"), "files")
    return _as_findings(rows, "SLP090", F.format_string("%d files in this directory", "files"))


def undeclared(facts: Tables, declared: set[str] | None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Imports at a module's top level that are neither of the standard library nor first-party nor declared, one finding each; none without a manifest."""
    top = F.element_at(F.split("module", r"\."), 1)
    rows = facts.imports.where("top and level = 0 and module is not null").select("path", "line", "column", top.alias("name")).where("name != ''")
    spark = facts.parsed.sparkSession
    if declared is None:
        rows = rows.limit(0)
    # a path's first folder, or the file at the top
    inner = F.regexp_replace(names.normal_path(F.col("path")), "^/*(src/)?", "")
    first = F.regexp_replace(F.element_at(F.split(inner, "/+"), 1), r"\.py$", "")
    first_party = facts.files.select(first.alias("name")).where("name != ''").distinct()
    known = {d for d in map(names.distribution, (*(declared or ()), *extra)) if d}
    aliased = {m for d, modules in ALIASES.items() for m in modules.split() if d.format(m) in known}
    spared = spark.createDataFrame([(x,) for x in sorted({*STANDARD, *ALWAYS, *aliased})], "name string")
    rows = rows.join(F.broadcast(spared), "name", "left_anti").join(first_party, "name", "left_anti")
    rows = rows.where(~X.normalise_distribution(F.col("name")).isin(*sorted(known or {""})))
    return _as_findings(rows, "SLP180", F.format_string("%s is not declared", "name"), F.col("column"))


def ghosts(facts: Tables) -> DataFrame:
    """Definitions that no file refers to, and settings read that none defines; the latter only where some file defines a setting at all."""
    parsed, test = facts.parsed, F.col("path").rlike(r"(^|/)(conftest\.py|test_[^/]*\.py|[^/]*_test\.py)$|(^|/)tests/")
    refs, words, keys = (parsed.select(F.explode(c).alias("name")) for c in ("refs", "string_words", "keys"))
    defs = facts.exploded("defs", "seq").where(F.col("free") & ~test)
    unused = relations.unreferenced(defs, refs, words)
    reads = facts.exploded("reads", "seq").withColumnRenamed("key", "name")
    undefined = relations.unreferenced_if_any(reads, keys.union(words), keys)
    said = _as_findings(unused, "SLP240", F.format_string("nothing refers to %s %s", "kind", "name"), F.col("column"))
    return said.union(_as_findings(undefined, "SLP240", F.format_string("nothing defines the setting %s", "name"), F.col("column")))


def findings(facts: Tables, config: Config | None = None, declared: set[str] | None = None) -> DataFrame:
    """Selected, unsuppressed findings in order of emission: path, line, column, code, severity, message, emit_seq."""
    config = config or Config()
    wanted = [c for c, (_, preview, _) in CATALOGUE.items() if config.enabled(c, preview)]
    rows = facts.findings.select(*_COLUMNS, "emit_seq").where(F.col("code").isin(*wanted) if wanted else F.lit(False))
    whole = [("SLP020", lambda: near_duplicates(facts, config)), ("SLP090", lambda: crowded(facts, int(config.limit("dir_max_modules")))), ("SLP180", lambda: undeclared(facts, declared, config.extra.get("imports", ()))), ("SLP240", lambda: ghosts(facts))]
    for i, (code, make) in enumerate(whole):
        if code in wanted:
            rows = rows.union(make().withColumn("emit_seq", F.lit(1_000_000 + i).cast("long")))
    return relations.unsuppressed(rows, facts.noqa).select(*_COLUMNS, "emit_seq")


# ---- sinks --------------------------------------------------------------------------------------------------------


def text_lines(rows: DataFrame) -> DataFrame:
    """One line a finding, by place and code; a sentinel where there is none."""
    line = F.format_string("%s: %d:%d %s [%s] %s", "path", "line", "column", "code", "severity", "message").alias("value")
    some = rows.orderBy("path", "line", "column", "code", "emit_seq").select(line)
    return some.union(rows.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("No diagnostics.")))


def agent_lines(rows: DataFrame) -> DataFrame:
    return rows.orderBy("path", "emit_seq").select(F.format_string("%s:%d:%d: %s %s", "path", "line", "column", "code", "message").alias("value"))


def _gathered(rows: DataFrame, one: Column) -> DataFrame:
    """One row with all findings in order; a document is one value, so this is for a report's size of findings."""
    ordered = F.array_sort(F.collect_list(F.struct("path", "emit_seq", one.alias("f"))))
    return rows.agg(F.transform(ordered, lambda x: x["f"]).alias("all"))


def json_document(rows: DataFrame) -> DataFrame:
    one = F.struct("path", "code", "message", "severity", "line", "column")
    return _gathered(rows, one).select(F.to_json(F.struct(F.col("all").alias("findings"))).alias("value"))


def sarif(rows: DataFrame, tool: str = "tessera") -> DataFrame:
    place = F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn")).alias("region"))
    one = F.struct(F.col("code").alias("ruleId"), F.col("severity").alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(F.struct(place.alias("physicalLocation"))).alias("locations"))
    driver = F.struct(F.struct(F.lit(tool).alias("name"), F.array().cast("array<string>").alias("rules")).alias("driver"))
    run = F.struct(driver.alias("tool"), F.col("all").alias("results"))
    return _gathered(rows, one).select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("value"))


def by_code(rows: DataFrame) -> DataFrame:
    return rows.groupBy("code").agg(F.count("*").alias("n"))


def markdown(rows: DataFrame) -> DataFrame:
    """A table of counts by code with the total, as ordered lines."""
    counts = by_code(rows)
    body = counts.select(F.concat(F.lit("1"), "code").alias("k"), F.format_string("| %s | %d |", "code", "n").alias("value"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("2").alias("k"), F.format_string("| **total** | %d |", "n").alias("value"))
    head = rows.sparkSession.createDataFrame([("0a", "| code | findings |"), ("0b", "| --- | ---: |")], "k string, value string")
    return head.union(body).union(total).orderBy("k").select("value")


def rule_catalogue(spark: SparkSession) -> DataFrame:
    """Every rule: code, name, whether it is in preview, what it says."""
    return spark.createDataFrame([(c, n, p, e) for c, (n, p, e) in sorted(CATALOGUE.items())], "code string, name string, preview boolean, explanation string")


def rule_detail(code: str) -> dict:
    """One rule by its code, in any case, or its name; an unknown one is an error."""
    for c, (name, preview, said) in CATALOGUE.items():
        if code.upper() == c or code.lower() == name:
            return {"code": c, "name": name, "preview": preview, "explanation": said}
    raise KeyError(f"there is no rule {code}")


def catalogue_json() -> str:
    return json.dumps([rule_detail(c) for c in sorted(CATALOGUE)], indent=2)
