"""Near-duplicate functions: pairs between distinct shingle sets, counted and named without expanding copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import graphs, similarity
from tessera.operators.store import written

LEAST_STATEMENTS = 3


def unit_id() -> Column:
    """Sorts as file by file, folder by folder, then in source order."""
    return F.concat(F.replace("path", F.lit("/"), F.lit("\x01")), F.lit("\x02"), F.lpad(F.col("fn_idx").cast("string"), 9, "0"))


def entries(units: DataFrame, least: int = LEAST_STATEMENTS) -> tuple[DataFrame, DataFrame]:
    """(members, sets): uid and entry of every eligible unit; id, shingles and n of each distinct shingle set, whose id is its smallest uid.

    Sets are told apart by 128 bits of hashes; the sets themselves travel once, with one unit each.
    """
    digest = (F.xxhash64("shingles").alias("x"), F.xxhash64(F.lit(1), F.reverse("shingles")).alias("y"))
    fit = units.where((F.col("statements") >= least) & (F.size("shingles") > 0)).withColumn("uid", unit_id())
    keyed = written(fit.select(*[c for c in fit.columns if c != "shingles"], *digest), "keyed-units")
    firsts = keyed.groupBy("x", "y").agg(F.min("uid").alias("id"), F.count("*").alias("n"))
    members = written(keyed.join(firsts.select("x", "y", F.col("id").alias("entry")), ["x", "y"]).drop("x", "y"), "members")
    sets = fit.select(F.col("uid").alias("id"), "shingles").join(firsts.select("id", "n"), "id")
    return members, written(sets, "sets")


def clone_findings(units: DataFrame, least: int = LEAST_STATEMENTS, similar: float = similarity.THRESHOLD) -> DataFrame:
    """For each function with a near-duplicate its lowest partner and the similarity in whole percent: path, line, name, partner, percent."""
    members, sets = entries(units, least)
    links = written(similarity.links(sets.select("id", "shingles"), similar), "links")
    both = links.select(F.col("a").alias("entry"), F.col("b").alias("other"), "similarity").union(links.select("b", "a", "similarity"))
    near = both.groupBy("entry").agg(F.min(F.struct(F.col("other").alias("uid"), F.col("similarity").alias("s"))).alias("near"))
    nth = F.row_number().over(Window.partitionBy("entry").orderBy("uid"))
    second = members.withColumn("k", nth).where("k = 2").select("entry", F.struct("uid", F.lit(1.0).alias("s")).alias("second"))
    first = F.when(F.col("uid") != F.col("entry"), F.struct(F.col("entry").alias("uid"), F.lit(1.0).alias("s")))
    rows = members.join(near, "entry", "left").join(second, "entry", "left")
    own = F.coalesce(first, F.when(F.col("uid") == F.col("entry"), F.col("second")))
    rows = rows.withColumn("partner", F.least(own, F.col("near"))).where("partner is not null")
    name = members.select(F.col("uid").alias("partner_uid"), F.col("path").alias("partner_path"), F.col("name").alias("partner_name"))
    percent = F.round(F.col("partner.s") * 100).cast("long").alias("percent")
    return rows.select("path", "line", "name", F.col("partner.uid").alias("partner_uid"), percent).join(name, "partner_uid").drop("partner_uid")


def clone_stats(units: DataFrame, profiles: DataFrame | None = None, least: int = LEAST_STATEMENTS, similar: float = similarity.THRESHOLD) -> DataFrame:
    """pairs, in_clones, functions, largest_cluster and ratio: one row, or with ``profiles`` (path, profile) one a profile, of the pairs within it."""
    members, sets = entries(units, least)
    links = written(similarity.links(sets.select("id", "shingles"), similar).select("a", "b"), "links")
    every = (lambda df: df.withColumn("profile", F.lit("all"))) if profiles is None else (lambda df: df.join(profiles, "path"))
    sizes = written(every(members.select("path", F.col("entry").alias("id"))).groupBy("profile", "id").agg(F.count("*").alias("n")), "sizes")
    one, two = sizes.toDF("profile", "a", "na"), sizes.toDF("profile", "b", "nb")
    mine = written(links.join(one, "a").join(two, ["profile", "b"]), "links-by-profile")
    across = mine.groupBy("profile").agg(F.sum(F.col("na") * F.col("nb")).alias("across"))
    within = sizes.groupBy("profile").agg(F.sum(F.expr("n * (n - 1) div 2")).alias("within"))
    # nodes of a profile are joined by its own links only
    node = lambda c: F.concat_ws("\x00", "profile", c)
    of = graphs.connected_components(mine.select(node("a").alias("a"), node("b").alias("b"))).withColumnRenamed("node", "k")
    grouped = sizes.withColumn("k", node("id")).join(of, "k", "left").groupBy("profile", F.coalesce("component", "k").alias("c")).agg(F.sum("n").alias("n")).where("n > 1")
    cluster = grouped.groupBy("profile").agg(F.sum("n").alias("in_clones"), F.max("n").alias("largest_cluster"))
    total = every(units.select("path")).groupBy("profile").agg(F.count("*").alias("functions"))
    if profiles is None:
        total = units.agg(F.count("*").alias("functions")).withColumn("profile", F.lit("all"))
    row = total.join(across, "profile", "left").join(within, "profile", "left").join(cluster, "profile", "left").na.fill(0)
    ratio = F.when(F.col("functions") > 0, F.col("in_clones") / F.col("functions")).otherwise(0.0)
    out = row.select("profile", (F.col("across") + F.col("within")).alias("pairs"), "in_clones", "functions", "largest_cluster", ratio.alias("ratio"))
    return out if profiles is not None else out.drop("profile")
