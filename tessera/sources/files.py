"""Source files: scanning folders, names of paths and modules, dependency manifests, configuration."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import TYPE_CHECKING

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from tessera.sources.rules import Settings

_MARKERS = ("swagger-codegen", "openapi-generator", "do not edit", "@generated")
HEADER_LINES = 40


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder or file (a path of this machine's, or a URI) and its path there."""
    return pafs.FileSystem.from_uri(folder if re.match("[a-z][a-z0-9+.-]*:/", folder) else str(Path(folder).resolve()))


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of the Python and .gitignore files below a folder. The driver lists one level, tasks what is below it.

    Spark's own readers leave out names that begin with a stroke or a dot, ``__init__.py`` among them.
    """
    fs, root = _opened(folder)
    first = [(f.path, f.type == pafs.FileType.Directory) for f in fs.get_file_info(pafs.FileSelector(root))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _opened(folder)
        for batch in batches:
            for path, below in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = [f.path for f in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if f.type == pafs.FileType.File] if below else [path]
                yield pa.RecordBatch.from_arrays([pa.array([p for p in found if p.endswith((".py", "/.gitignore"))], pa.string())], names=["path"])

    rows = spark.createDataFrame(first, "path string, below boolean")
    return rows.repartition(max(1, min(len(first), spark.sparkContext.defaultParallelism))).mapInArrow(run, "path string")


def _read(paths: DataFrame, folder: str) -> DataFrame:
    """(path, source); null for what can't be read or is no UTF-8."""

    def text(fs: pafs.FileSystem, path: str) -> str | None:
        try:
            with fs.open_input_file(path) as file:
                return file.read().decode()
        except (OSError, UnicodeDecodeError):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _opened(folder)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.column(0).slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part, pa.array([text(fs, p) for p in part.to_pylist()], pa.string())], names=["path", "source"])

    return paths.select("path").mapInArrow(run, "path string, source string")


def scan(spark: SparkSession, *folders: str) -> DataFrame:
    """(path, source) of every .py file below the folders; what is no UTF-8 or can't be read has a null source."""
    found = spark.createDataFrame([], "path string, source string")
    for folder in folders:
        found = found.union(_read(_listed(spark, folder).where(F.col("path").endswith(".py")).repartition("path"), folder))
    return found


def discover(spark: SparkSession, *paths: str) -> tuple[DataFrame, list[str]]:
    """(path, source) of the .py files named or below the folders named, each once, and the paths that are missing.

    Below a folder, hidden files and folders are left out and so is what .gitignore files from the folder down say; a file that is named is taken.
    """
    found, missing = spark.createDataFrame([], "path string, source string"), []
    for path in paths or (".",):
        fs, root = _opened(path)
        kind = fs.get_file_info(root).type
        if kind == pafs.FileType.NotFound:
            missing.append(path)
        elif kind == pafs.FileType.File:
            found = found.union(_read(spark.createDataFrame([(root,)] if root.endswith(".py") else [], "path string"), path))
        else:
            listed = _listed(spark, path)
            # a project's ignore files are a few small ones
            texts = _read(listed.where(F.col("path").endswith("/.gitignore")), path).where("source is not null").collect()
            patterns = sorted((r["path"][len(root) :].strip("/").rpartition("/")[0], r["source"]) for r in texts)
            inner = F.substring(F.col("path"), len(root.rstrip("/")) + 2, 1 << 20)
            found = found.union(_read(listed.where(F.col("path").endswith(".py") & ~ignored(inner, patterns)).repartition("path"), path))
    return found.dropDuplicates(["path"]), missing


def _ignore_rules(files: list[tuple[str, str]]) -> list[tuple[re.Pattern, bool]]:
    """(expression over a path of a file or folder, whether it ignores) of .gitignore files (folder, text), in order of precedence, the last that matches counts."""
    out = []
    for folder, text in files:
        for line in text.splitlines():
            line = line.rstrip() if not line.rstrip(" ").endswith("\\") else line
            if not line or line.startswith("#"):
                continue
            keeps, line = line.startswith("!"), line.removeprefix("!").removeprefix("\\")
            only_folders, line = line.endswith("/"), line.rstrip("/")
            anchored, line = "/" in line, line.lstrip("/")
            body = _git_glob(line)
            head = re.escape(folder + "/") if folder else ""
            # folders end with a stroke here, files do not
            out.append((re.compile(f"{head}{'' if anchored else '(?:.*/)?'}{body}{'/' if only_folders else '/?'}"), not keeps))
    return out


def _git_glob(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "/.+", i + 3
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and (end := glob.find("]", i + 2)) > 0:
            out, i = out + "[" + ("^" if glob[i + 1] in "!^" else "") + re.sub(r"([\\\[])", r"\\\1", glob[i + 1 + (glob[i + 1] in "!^") : end]) + "]", end + 1
        else:
            i += glob[i] == "\\" and i + 1 < len(glob)
            out, i = out + re.escape(glob[i]), i + 1
    return out


def is_ignored(path: str, rules: list[tuple[re.Pattern, bool]]) -> bool:
    """Whether the file or a folder above it is hidden or ignored; nothing below an ignored folder comes back."""
    parts = path.split("/")
    for i, part in enumerate(parts, 1):
        here = "/".join(parts[:i]) + ("/" if i < len(parts) else "")
        told = next((yes for expression, yes in reversed(rules) if expression.fullmatch(here)), part.startswith("."))
        if told:
            return True
    return False


def ignored(path: Column, files: list[tuple[str, str]]) -> Column:
    @F.arrow_udf("boolean")
    def run(paths: pa.Array) -> pa.Array:
        rules = _ignore_rules(files)
        return pa.array([is_ignored(p, rules) for p in paths.to_pylist()], pa.bool_())

    return run(path)


def normal_path(path: Column) -> Column:
    return F.regexp_replace(path, r"^\./", "")


def is_generated(path: str, text: str) -> bool:
    """A marker within the first lines, or the suffix of generated protocol code."""
    if path.endswith(("_pb2.py", "_pb2_grpc.py")):
        return True
    head = "\n".join(text.split("\n", HEADER_LINES)[:HEADER_LINES]).lower()
    return any(m in head for m in _MARKERS)


def module_of(path: Column) -> Column:
    """Dotted module name below an optional ``src/``; a package for its ``__init__``; null for a root ``__init__`` and what is no .py file."""
    stem = F.regexp_replace(F.regexp_replace(normal_path(path), "^src/", ""), r"(^|/)__init__\.py$|\.py$", "")
    return F.when(path.endswith(".py") & (stem != ""), F.replace(stem, F.lit("/"), F.lit(".")))


def rooted_modules(files: DataFrame) -> DataFrame:
    """(path, module) with names from the source root: the nearest folder above that is no package (has no ``__init__.py``)."""
    path = normal_path(F.col("path"))
    folder = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    packages = files.where(is_package(path)).select(folder.alias("folder")).where("folder != ''").distinct().withColumn("package", F.lit(True))
    parts = F.split(path, "/")
    above = files.select("path", F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("depth", "folder"))
    known = above.join(packages, "folder", "left")
    # folders above the file, the deepest that is no package last
    roots = known.groupBy("path").agg(F.coalesce(F.max(F.when(F.col("package").isNull() | (F.size(F.split("path", "/")) == 1), F.col("depth") + 1)), F.lit(0)).alias("root"))
    inner = F.array_join(F.slice(parts, F.when(F.size(parts) == 1, F.lit(1)).otherwise(F.col("root") + 1), F.size(parts)), ".")
    return roots.select("path", F.regexp_replace(F.regexp_replace(inner, r"\.py$", ""), r"(^|\.)__init__$", "").alias("module")).where("module != ''")


def is_package(path: Column) -> Column:
    return path.rlike(r"(^|/)__init__\.py$")


def package_of(module: Column, package: Column) -> Column:
    """A package is its own; a module's is what stands before its last dot, ``.`` at the top."""
    parent = F.regexp_extract(module, r"^(.*)\.[^.]*$", 1)
    return F.when(package, module).when(parent == "", ".").otherwise(parent)


def distribution(name: str) -> str:
    return re.sub(r"[-_.]+", "-", name.strip().lower()).strip("-")


def requirement(line: str) -> str | None:
    """The normalised distribution of a requirement line; None for options, comments and addresses without a name."""
    line = line.strip()
    if egg := re.search(r"#egg=([A-Za-z0-9._-]+)", line):
        return distribution(egg[1])
    if not line or line[0] in "#-" or re.match(r"[a-z+]+://", line):
        return None
    found = re.match(r"([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)\s*(?:$|[\[<>=!~;@# (,])", line)
    return distribution(found[1]) if found else None


def declared(manifest: str, kind: str) -> set[str] | None:
    """Distributions that a pyproject.toml (``kind`` toml) or requirements file names; None where a pyproject has no table for them."""
    if kind != "toml":
        return {d for d in map(requirement, manifest.splitlines()) if d}
    try:
        told = tomllib.loads(manifest)
    except tomllib.TOMLDecodeError:
        return None
    project, poetry = told.get("project", {}), told.get("tool", {}).get("poetry", {})
    lists = [project.get("dependencies"), *project.get("optional-dependencies", {}).values(), *told.get("dependency-groups", {}).values()]
    tables = [poetry.get("dependencies"), poetry.get("dev-dependencies"), *(g.get("dependencies") for g in poetry.get("group", {}).values())]
    lists, tables = [x for x in lists if x is not None], [t for t in tables if t is not None]
    if not (lists or tables or "optional-dependencies" in project or "dependency-groups" in told):
        return None
    found = {d for x in lists for line in x if isinstance(line, str) and (d := requirement(line))}
    return found | {distribution(n) for t in tables for n in t if n.lower() != "python"}


def find_manifest(folder: str) -> set[str] | None:
    """What the nearest manifest declares, in the folder or above: its pyproject.toml, else the requirements*.txt beside it; None without one.

    A pyproject.toml ends the search, also where neither it nor a file beside it declares anything.
    """
    for place in (Path(folder).resolve(), *Path(folder).resolve().parents):
        project = place / "pyproject.toml"
        if project.is_file() and (found := declared(project.read_text(errors="replace"), "toml")) is not None:
            return found
        lists = sorted(p for p in place.glob("requirements*.txt") if p.is_file())
        if lists:
            return set().union(*(declared(p.read_text(errors="replace"), "txt") for p in lists))
        if project.is_file():
            return None
    return None


@dataclass(frozen=True)
class Profile:
    """A named part of the files by globs, by generated content, or (``default``) of what is in no other; with what differs for its rules."""

    name: str
    match: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    default: bool = False
    generated: bool = False
    ignore: tuple[str, ...] = ()
    allow_comments: bool = False
    limits: tuple[tuple[str, float], ...] = ()

    def matches(self, path: str, generated: bool) -> bool:
        if self.generated and generated:
            return True
        return any(re.fullmatch(glob(g), path) for g in self.match) and not any(re.fullmatch(glob(g), path) for g in self.exclude)


def glob(pattern: str) -> str:
    """A regular expression of a glob whose * crosses strokes, with ** for any number of folders; for Python and the JVM."""
    out = "".join({"**/": "(?:.*/)?", "*": ".*", "**": ".*", "?": "."}.get(x) or re.sub(r"([^\w/])", r"\\\1", x) for x in re.findall(r"\*\*/|\*\*|.", pattern, re.S))
    return f"(?s:{out})"


_TESTS = tuple(f"{deep}{name}" for deep in ("", "**/") for name in ("test_*.py", "*_test.py", "conftest.py", "tests/**", "test/**"))
DEFAULT_PROFILES = (
    Profile("tests", _TESTS), Profile("generated", tuple(f"{deep}*_pb2{kind}.py" for deep in ("", "**/") for kind in ("", "_grpc")), generated=True), Profile("production", default=True),
)
#: Limits by their name in a configuration: where rules have them, and what they are. Those of whole projects are not of a profile.
LIMITS = {
    "file_max_lines": ("file_lines", 400), "nesting_max_depth": ("nesting", 4), "data_nesting_max_depth": ("data_nesting", 3), "dispatch_max_branches": ("ladder", 3),
    "max_identifier_words": ("name_words", 4), "dir_max_modules": (None, 15), "lcom4_max_components": ("class_parts", 1), "lcom4_min_methods": ("class_methods", 3),
    "corrupted_prose_ratio": ("prose", 0.5),
}
CONFIG_FILE = "tessera.toml"


@dataclass(frozen=True)
class Config:
    """Selection of rules by prefixes of their codes, profiles of files, limits, words of one's own."""

    select: tuple[str, ...] = ("SLP",)
    ignore: tuple[str, ...] = ()
    preview: bool = False
    profiles: tuple[Profile, ...] = DEFAULT_PROFILES
    limits: dict = field(default_factory=dict)
    clone: dict = field(default_factory=lambda: {"min_statements": 3, "similarity": 0.85})
    badges: dict = field(default_factory=lambda: {"include": None, "summary": []})
    extra: dict = field(default_factory=dict)

    def enabled(self, code: str, is_preview: bool) -> bool:
        return (self.preview or not is_preview) and code.startswith(self.select) and not (self.ignore and code.startswith(self.ignore))

    def limit(self, name: str) -> float:
        return self.limits.get(name, LIMITS[name][1])

    def profiles_of(self, path: str, generated: bool) -> list[str]:
        """Every profile that a file is in; the default one where it is in no other."""
        rest = next((p.name for p in self.profiles if p.default), None)
        return [p.name for p in self.profiles if not p.default and p.matches(path, generated)] or ([rest] if rest else [])

    def settings_of(self, path: str, generated: bool = False) -> Settings:
        """The rules' settings for a file: the project's, with what its profiles change, in their order."""
        from tessera.sources.rules import Settings

        mine = set(self.profiles_of(path, generated))
        of = [p for p in self.profiles if p.name in mine]
        limits = {name: self.limit(name) for name in LIMITS} | {k: v for p in of for k, v in p.limits}
        words = {to: tuple(self.extra.get(kind, ())) for kind, to in (("security", "guards"), ("placeholders", "placeholders"), ("comments", "hedging"), ("crosslang", "idioms_allowed"))}
        told = {to: limits[name] for name, (to, _) in LIMITS.items() if to}
        return Settings(**told, **words, ignored=tuple(x for p in of for x in p.ignore), comments_allowed=any(p.allow_comments for p in of))


def _only(told: dict, known: set[str], where: str) -> dict:
    if unknown := set(told) - known:
        raise ValueError(f"unknown keys in {where}: {sorted(unknown)}")
    return told


def read_config(text: str) -> Config:
    """From TOML; an unknown key is an error, at any depth."""
    words = {"imports": "extra", "security": "extra", "placeholders": "extra", "comments": "extra", "crosslang": "allow"}
    told = _only(tomllib.loads(text), {"select", "ignore", "preview", "profiles", "clone", "limits", "badges", *words}, "the configuration")
    default = Config()
    profiles = default.profiles
    if "profiles" in told:
        keys = {"name", "match", "exclude", "default", "generated", "ignore", "allow_comments", "limits"}
        profiles = tuple(
            Profile(**{k: tuple(v) if isinstance(v, list) else tuple(sorted(_only(v, set(LIMITS), "limits").items())) if k == "limits" else v for k, v in _only(p, keys, "a profile").items()})
            for p in told["profiles"]
        )
    return replace(
        default, select=tuple(told.get("select", default.select)), ignore=tuple(told.get("ignore", ())), preview=told.get("preview", False), profiles=profiles,
        limits=_only(told.get("limits", {}), set(LIMITS), "limits"), clone=default.clone | _only(told.get("clone", {}), set(default.clone), "clone"),
        badges=default.badges | _only(told.get("badges", {}), set(default.badges), "badges"), extra={k: tuple(_only(told[k], {key}, k).get(key, ())) for k, key in words.items() if k in told},
    )


def find_config(folder: str) -> Config:
    """From the nearest configuration file, in the folder or above; the default without one."""
    for place in (Path(folder).resolve(), *Path(folder).resolve().parents):
        if (place / CONFIG_FILE).is_file():
            return read_config((place / CONFIG_FILE).read_text())
    return Config()


def file_profiles(files: DataFrame, config: Config) -> DataFrame:
    """(path, profile), one row for each profile of a file; patterns are matched inside the JVM."""

    def one(p: Profile) -> Column:
        def any_of(globs: tuple[str, ...]) -> Column:
            return F.col("path").rlike("^(?:" + "|".join(map(glob, globs)) + ")$") if globs else F.lit(False)

        told = any_of(p.match) & ~any_of(p.exclude)
        return F.when((told | F.col("is_generated")) if p.generated else told, F.lit(p.name))

    own = [p for p in config.profiles if not p.default]
    rest = [F.lit(p.name) for p in config.profiles if p.default][:1]
    found = F.array_compact(F.array(*map(one, own))) if own else F.array().cast("array<string>")
    return files.select("path", F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(*rest).cast("array<string>"))).alias("profile"))
