"""Relational kernels over plain columns: joins, anti-joins and rollups that do not care where their rows come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unreferenced(definitions: DataFrame, *references: DataFrame, on: str = "name") -> DataFrame:
    """Definitions whose name is in none of the reference relations: one distinct union, one left anti join."""
    names = references[0].select(on)
    for other in references[1:]:
        names = names.union(other.select(on))
    return definitions.join(names.distinct(), on, "left_anti")


def unreferenced_if_any(definitions: DataFrame, references: DataFrame, guard: DataFrame, on: str = "name") -> DataFrame:
    """As ``unreferenced``, but nothing while ``guard`` is empty."""
    some = guard.limit(1).select(F.lit(1).alias("__guard"))
    return unreferenced(definitions, references, on=on).join(some, how="cross").drop("__guard")


def without_match(rows: DataFrame, candidates: Column, known: DataFrame, key: list[str], name: str) -> DataFrame:
    """Rows of which none of the candidate names is known: explode, left join, grouped any."""
    tried = rows.select(*key, F.explode(candidates).alias(name)).join(known.select(name, F.lit(True).alias("__hit")).distinct(), name, "left")
    missed = tried.groupBy(*key).agg(F.bool_or(F.coalesce("__hit", F.lit(False))).alias("__any")).where("not __any").drop("__any")
    return rows.join(missed, key, "left_semi")


def known_uses(uses: DataFrame, known: DataFrame, key: list[str], on: str, count: str) -> DataFrame:
    """How many rows of ``uses`` each key has whose name is known, with multiplicity: a semi join never repeats them."""
    return uses.join(known.select(on), on, "left_semi").groupBy(*key).agg(F.count("*").alias(count))


def lowest_partner(pairs: DataFrame) -> DataFrame:
    """For each member of pairs (a, b, similarity) its partner of lowest number, with the similarity in whole percent."""
    return lowest(pairs.select(F.col("a").alias("member"), F.col("b").alias("partner"), "similarity").union(pairs.select("b", "a", "similarity")))


def lowest(both: DataFrame) -> DataFrame:
    """For each member of (member, partner, similarity) the partner of lowest number, with the similarity in whole percent."""
    best = both.groupBy("member").agg(F.min(F.struct("partner", "similarity")).alias("m"))
    return best.select("member", F.col("m.partner").alias("partner"), F.round(F.col("m.similarity") * 100).cast("long").alias("percent"))


def degrees(edges: DataFrame) -> DataFrame:
    """fan_out, fan_in and distinct neighbours in either direction of every node of directed edges (src, dst); self edges do not count."""
    edges = edges.where("src != dst").select("src", "dst").distinct()
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(
        edges.select("dst", "src", F.lit(0), F.lit(1))
    )
    per = both.groupBy("node", "other").agg(F.max("o").alias("o"), F.max("i").alias("i"))
    return per.groupBy("node").agg(F.sum("o").cast("long").alias("fan_out"), F.sum("i").cast("long").alias("fan_in"), F.count("*").alias("cbo_modified"))


def merge_edges(edges: DataFrame, flags: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """One row an edge (of each value of ``by``), its flags or-ed."""
    return edges.where("src != dst").groupBy(*by, "src", "dst").agg(*[F.bool_or(f).alias(f) for f in flags])


def martin_metrics(ce: Column, ca: Column, abstract: Column, classes: Column) -> tuple[Column, Column, Column]:
    """instability, abstractness and distance from the main sequence, with zero guards."""
    instability = F.coalesce(F.try_divide(ce, ce + ca), F.lit(0.0))
    abstractness = F.coalesce(F.try_divide(abstract, classes), F.lit(0.0))
    return instability, abstractness, F.abs(abstractness + instability - 1.0)


def package_rows(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """modules (module, package, loc, classes, abstract) and module edges (src, dst) rolled up by package."""
    of = modules.select("module", "package")
    between = (
        edges.join(of.withColumnRenamed("module", "src").withColumnRenamed("package", "p"), "src")
        .join(of.withColumnRenamed("module", "dst").withColumnRenamed("package", "q"), "dst")
        .where("p != q").select("p", "q").distinct()
    )
    out = between.groupBy("p").agg(F.array_sort(F.collect_set("q")).alias("imports")).withColumnRenamed("p", "package")
    into = between.groupBy("q").agg(F.array_sort(F.collect_set("p")).alias("imported_by")).withColumnRenamed("q", "package")
    sums = modules.groupBy("package").agg(
        F.count("*").alias("modules"), F.sum("loc").alias("loc"), F.sum("classes").alias("classes"), F.sum("abstract").alias("abstract_classes")
    )
    none = F.array().cast("array<string>")
    rows = sums.join(out, "package", "left").join(into, "package", "left")
    rows = rows.withColumn("imports", F.coalesce("imports", none)).withColumn("imported_by", F.coalesce("imported_by", none))
    rows = rows.withColumn("ce", F.size("imports").cast("long")).withColumn("ca", F.size("imported_by").cast("long"))
    i, a, d = martin_metrics(F.col("ce"), F.col("ca"), F.col("abstract_classes"), F.col("classes"))
    return rows.withColumn("instability", i).withColumn("abstractness", a).withColumn("distance", d)


def concentration(sizes: DataFrame, group: str, size: str) -> DataFrame:
    """One row: groups, total, largest group (ties: the smallest name), its share, and the Gini coefficient of the sizes.

    Ranks need no global sort of the groups: equal sizes are counted first, and only the
    distinct sizes are ranked.
    """
    counts = sizes.groupBy(F.col(size).cast("long").alias("x")).agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("b", before)
    # the ranks b + 1 to b + c of c groups of size x sum to c (2 b + c + 1) / 2
    weighted = F.sum(F.col("x") * F.col("c") * (2 * F.col("b") + F.col("c") + 1) / 2)
    sums = ranked.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("groups"), F.coalesce(F.sum(F.col("x") * F.col("c")), F.lit(0)).alias("total"), weighted.alias("w"))
    top = sizes.agg(F.min(F.struct(F.negative(F.col(size).cast("long")).alias("n"), F.col(group).alias("g"))).alias("t"))
    n, total = F.col("groups"), F.col("total")
    return sums.join(top, how="cross").select(
        "groups", "total", F.col("t.g").alias("largest"), F.when(total > 0, -F.col("t.n") / total).otherwise(0.0).alias("max_share"),
        F.when(total > 0, 2.0 * F.col("w") / (n * total) - (n + 1) / n).otherwise(0.0).alias("gini"),
    )


def concentration_by(sizes: DataFrame, by: str, group: str, size: str) -> DataFrame:
    """``concentration`` as a struct for each value of ``by``; ranks within it, by distinct sizes."""
    counts = sizes.groupBy(by, F.col(size).cast("long").alias("x")).agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(by).orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = counts.withColumn("b", before).groupBy(by).agg(
        F.sum("c").alias("groups"), F.sum(F.col("x") * F.col("c")).alias("total"), F.sum(F.col("x") * F.col("c") * (2 * F.col("b") + F.col("c") + 1) / 2).alias("w")
    )
    top = sizes.groupBy(by).agg(F.min(F.struct(F.negative(F.col(size).cast("long")).alias("n"), F.col(group).alias("g"))).alias("t"))
    n, total = F.col("groups"), F.col("total")
    share, gini = F.try_divide(-F.col("t.n"), total), 2.0 * F.col("w") / (n * total) - (n + 1) / n
    return sums.join(top, by).select(by, F.struct("groups", "total", F.col("t.g").alias("largest"), share.alias("max_share"), gini.alias("gini")).alias("concentration"))


def crowded_directories(files: DataFrame, limit: int, path: str = "path") -> DataFrame:
    """Directories of more than ``limit`` files, with the count and the first file."""
    directory = F.regexp_replace(F.col(path), "/?[^/]*$", "")
    return files.groupBy(directory.alias("directory")).agg(F.count("*").alias("files"), F.min(path).alias("first_file")).where(F.col("files") > limit)


def first_writer(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__nth = 1").drop("__nth")


def unsuppressed(findings: DataFrame, directives: DataFrame) -> DataFrame:
    """Findings (path, line, code) that no directive (path, line, codes; null codes silence all) on their line names: two anti joins."""
    blanket = directives.where("codes is null").select("path", "line").distinct()
    coded = directives.where("codes is not null").select("path", "line", F.explode("codes").alias("code")).distinct()
    return findings.join(blanket, ["path", "line"], "left_anti").join(coded, ["path", "line", "code"], "left_anti")
