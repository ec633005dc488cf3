"""Import graph of modules, resolved by joins; class hierarchy and coupling by name. No driver-side loops over rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import graphs, relations
from tessera.operators.store import written
from tessera.sources import files as names


def modules(files: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """node (a path), module, package, is_package of every file that has a module name; of equal names the last path is the one that imports mean.

    ``by`` names columns that keep graphs apart (a profile), here and below.
    """
    found = files.select(*by, F.col("path").alias("node"), names.module_of(F.col("path")).alias("module"), names.is_package(F.col("path")).alias("is_package"))
    found = found.where("module is not null").withColumn("package", names.package_of(F.col("module"), F.col("is_package")))
    last = F.max("node").over(Window.partitionBy(*by, "module"))
    return found.withColumn("named", F.col("node") == last)


def candidates(imports: DataFrame, mods: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(path, src, candidate, flags) of every name that an import could mean; a relative import above the root means nothing."""
    rows = imports.join(mods.select(*by, F.col("node").alias("path"), F.col("module").alias("src"), "is_package"), [*by, "path"])
    parts = F.split("src", r"\.")
    keep = F.when(F.col("is_package"), F.size(parts)).otherwise(F.size(parts) - 1) - (F.col("level") - 1)
    anchor = F.when(F.col("level") == 0, F.array().cast("array<string>")).when(keep >= 0, F.slice(parts, F.lit(1), F.greatest(keep, F.lit(0)).cast("int")))
    base = F.concat(anchor, F.when(F.col("module").isNotNull(), F.split("module", r"\.")).otherwise(F.array().cast("array<string>")))
    listed = F.transform("names", lambda n: F.array_join(F.concat(F.col("base"), F.array(n)), "."))
    rows = rows.withColumn("base", base).where("base is not null")
    every = F.when(F.size("names") == 0, F.array(F.array_join("base", "."))).otherwise(listed)
    runtime = ~F.col("type_checking") & ~F.col("local")
    return rows.select(*by, "path", "src", F.explode(every).alias("candidate"), runtime.alias("runtime"), "type_checking", "local").where("candidate != ''")


def module_edges(imports: DataFrame, mods: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst, runtime, type_checking, local): the candidate itself where it is a module, else its parent; flags or-ed, no self edges."""
    known = mods.select(*by, "module").distinct()
    tried = candidates(imports, mods, by).withColumn("parent", F.regexp_extract("candidate", r"^(.*)\.[^.]*$", 1))
    exact = known.select(*by, F.col("module").alias("candidate"), F.col("module").alias("whole"))
    above = known.select(*by, F.col("module").alias("parent"), F.col("module").alias("part"))
    found = tried.join(exact, [*by, "candidate"], "left").join(above, [*by, "parent"], "left").withColumn("dst", F.coalesce("whole", "part")).where("dst is not null")
    return relations.merge_edges(found, ["runtime", "type_checking", "local"], by)


def graph_panel(mods: DataFrame, edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each value of ``by``: modules, edges, packages, tangles under three edge filters, propagation cost, modularities.

    The sequential algorithms see a whole graph in one task; a project has thousands of
    modules. ``graphs.reachable`` and ``graphs.strongly_connected`` are the distributed ways for larger edge tables.
    """
    key = by or ("g",)
    schema = (
        "modules long, edges long, packages long, package_edges long, tangles array<array<string>>, runtime_tangles long, load_bearing_tangles long, largest_tangle long, "
        "in_cycles long, propagation_cost double, q_declared double, q_detected double, modularity_gap double, communities long"
    )
    one = F.lit("all").alias("g")
    left = mods.select(*(by or (one,)), F.when(F.col("named"), F.col("module")).otherwise(F.col("node")).alias("node"), F.col("package").alias("community"), F.col("node").alias("path"))
    right = edges if by else edges.withColumn("g", F.lit("all"))

    def run(at: tuple, nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([dict(zip(key, at, strict=True)) | graphs.graph_panel(nodes.sort_values("path"), links.sort_values(["src", "dst"]))])

    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(run, ", ".join(f"{k} string" for k in key) + ", " + schema)
    return found if by else found.drop("g")


def packages(mods: DataFrame, edges: DataFrame, files: DataFrame, classes: DataFrame) -> DataFrame:
    """Package rows with loc, coupling, instability, abstractness, distance, and whether the package is on a cycle of packages' modules."""
    per = classes.groupBy(F.col("path").alias("node")).agg(F.count("*").alias("classes"), F.count_if("is_abstract").alias("abstract"))
    rows = mods.join(files.select(F.col("path").alias("node"), "loc"), "node").join(per, "node", "left").na.fill(0, ["classes", "abstract"])
    rolled = relations.package_rows(rows, edges)
    of = mods.select("module", "package").distinct()
    between = edges.join(of.toDF("src", "p"), "src").join(of.toDF("dst", "q"), "dst").where("p != q").select(F.col("p").alias("src"), F.col("q").alias("dst"))
    cyclic = graphs.strongly_connected(between).select(F.col("node").alias("package"), F.lit(True).alias("in_cycle"))
    return rolled.join(cyclic, "package", "left").withColumn("in_cycle", F.coalesce("in_cycle", F.lit(False)))


def class_panel(classes: DataFrame) -> DataFrame:
    """``classes`` with dit, noc, cbo, fan_out, fan_in, cbo_modified and nosi: all over names, across every file."""
    classes = written(classes, "classes")
    known = classes.select("name").distinct()
    links = written(
        classes.select(F.col("name").alias("src"), F.explode("coupled").alias("dst")).where("src != dst").join(known.withColumnRenamed("name", "dst"), "dst", "left_semi")
        .select("src", "dst").distinct(), "coupling",
    )
    key = ["path", "cls_idx"]
    own = classes.select(*key, "name", F.explode(F.array_distinct("coupled")).alias("dst")).where("name != dst").join(known.withColumnRenamed("name", "dst"), "dst", "left_semi")
    incoming = links.select(F.col("dst").alias("name"), F.col("src").alias("other"))
    cbo = own.groupBy(*key).agg(F.count("*").alias("cbo"))
    fan_in = incoming.groupBy("name").agg(F.count("*").alias("fan_in"))
    either = own.select(*key, F.col("dst").alias("other")).union(classes.select(*key, "name").join(incoming, "name").select(*key, "other")).distinct()
    modified = either.groupBy(*key).agg(F.count("*").alias("cbo_modified"))
    # a child counts once for each distinct base that it names, and each definition of it counts
    noc = classes.select(*key, F.explode(F.array_distinct("bases")).alias("base")).groupBy(F.col("base").alias("name")).agg(F.count("*").alias("noc"))
    nosi = relations.known_uses(classes.select(*key, F.explode("static_calls").alias("target")), known.withColumnRenamed("name", "target"), key, "target", "nosi")
    depth = depths(classes)
    out = classes.join(depth, "name", "left").join(noc, "name", "left").join(fan_in, "name", "left").join(cbo, key, "left").join(modified, key, "left").join(nosi, key, "left")
    return out.na.fill(0, ["dit", "noc", "cbo", "fan_in", "cbo_modified", "nosi"]).withColumn("fan_out", F.col("cbo"))


def depths(classes: DataFrame) -> DataFrame:
    """(name, dit): the longest path of first-party bases; a name's first definition gives its bases, links on a cycle are left out."""
    first = relations.first_writer(classes.select("name", "bases", "path", "cls_idx"), ["name"], ["path", "cls_idx"])
    links = first.select(F.col("name").alias("src"), F.explode("bases").alias("dst")).where("src != dst")
    links = links.join(first.select(F.col("name").alias("dst")), "dst", "left_semi").select("src", "dst")
    circle = graphs.strongly_connected(links)
    one, two = circle.select(F.col("node").alias("src"), F.col("component").alias("p")), circle.select(F.col("node").alias("dst"), F.col("component").alias("q"))
    straight = links.join(one, "src", "left").join(two, "dst", "left").where("p is null or q is null or p != q")
    parents = first.select(F.col("name").alias("node"), F.lit(None).cast("string").alias("parent")).union(straight.select("src", "dst"))
    return graphs.longest_path(parents).select(F.col("node").alias("name"), F.col("depth").alias("dit"))
