"""The metrics panel: one row a profile, each table grouped once and the groups joined on the profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import columns as X


def _spread(column: str, name: str | None = None) -> list[Column]:
    """mean, 95th percentile by nearest rank, maximum."""
    name = name or column
    return [X.mean(F.col(column)).alias(f"{name}_avg"), X.nearest_rank(column).alias(f"{name}_p95"), F.coalesce(F.max(column), F.lit(0)).alias(f"{name}_max")]


def _tiers(column: str, tier: str | None = None) -> list[Column]:
    bounds = X.TIERS[tier or column]
    counted = F.struct(*X.histogram(F.col(column), bounds)).alias(f"{column}_tiers")
    return [counted, X.worst_tier(F.col(column), bounds).alias(f"{column}_worst")]


def panel(files: DataFrame, functions: DataFrame, classes: DataFrame, profiles: DataFrame) -> DataFrame:
    """``profiles`` (path, profile) may put a file in several; ratios are 0 where nothing is counted."""
    public = ~F.col("name").startswith("_")
    logic = F.col("cognitive") >= 5
    full = F.col("has_return_annotation") & (F.col("typed_params") == F.col("annotatable_params"))
    by_function = functions.join(profiles, "path").groupBy("profile").agg(
        F.count("*").alias("functions"), *_spread("cyclomatic"), *_tiers("cyclomatic"), *_spread("cognitive"), *_tiers("cognitive"), *_spread("arity"), *_tiers("arity"),
        *_spread("ncss"), *_spread("params"), *_spread("max_nesting"), *_spread("loc", "function_loc"), F.coalesce(F.max(F.when(logic, F.col("loc"))), F.lit(0)).alias("max_logic_function_loc"),
        F.sum("typed_params").alias("typed"), F.sum("annotatable_params").alias("annotatable"), X.ratio(F.count_if(full), F.count("*")).alias("fully_annotated_rate"),
        F.count_if(public).alias("public_f"), F.count_if(public & F.col("has_docstring")).alias("documented_f"),
        X.ratio(F.sum("docstring_lines"), F.sum("ncss")).alias("docstring_code_ratio"),
    )
    by_class = classes.join(profiles, "path").groupBy("profile").agg(
        F.count("*").alias("classes"), *(c for m in ("wmc", "rfc", "noc", "cbo") for c in (*_spread(m), *_tiers(m))), *_spread("dit"), *_spread("lcom4"),
        X.mean(F.col("tcc")).alias("tcc_avg"), X.mean(F.col("lcc")).alias("lcc_avg"), X.mean(F.col("lcom_star")).alias("lcom_star_avg"),
        F.count_if("is_abstract").alias("abstract_classes"), F.count_if(public).alias("public_c"), F.count_if(public & F.col("has_docstring")).alias("documented_c"),
    )
    code = F.col("top_level_code") + F.col("function_code")
    share = F.when(code > 0, F.col("top_level_code") / code)
    by_file = files.where("parse_error is null").join(profiles, "path").groupBy("profile").agg(
        F.count("*").alias("files"), F.sum("loc").alias("loc"), X.ratio(F.sum("comment_lines"), F.sum("loc")).alias("comment_density"), *_spread("nloc"), *_tiers("nloc"),
        F.coalesce(F.avg(share), F.lit(0.0)).alias("top_level_ratio_avg"), F.coalesce(F.max(share), F.lit(0.0)).alias("top_level_ratio_max"),
        F.count_if((F.col("top_level_code") >= 15) & (share >= 0.6)).alias("undecomposed_files"), F.sum("handlers").alias("handlers"), F.sum("bare").alias("bare"),
        F.sum("broad").alias("broad"), F.sum("swallow").alias("swallow"), X.ratio(F.sum("broad"), F.sum("handlers")).alias("broad_rate"),
        X.ratio(F.sum("swallow"), F.sum("handlers")).alias("swallow_rate"),
    )
    joined = by_file.join(by_function, "profile", "left").join(by_class, "profile", "left")
    zero = {f.name: 0 for f in joined.schema if f.dataType.simpleString() in ("bigint", "int", "double") and f.name != "profile"}
    joined = joined.na.fill(zero)
    public_units, documented = F.col("public_f") + F.col("public_c"), F.col("documented_f") + F.col("documented_c")
    gods = [F.coalesce(F.col(f"{m}_tiers.very_high"), F.lit(0)) for m in ("cyclomatic", "cognitive", "wmc", "nloc")]
    return joined.withColumns({
        "god_cyclomatic": gods[0], "god_cognitive": gods[1], "god_wmc": gods[2], "god_nloc": gods[3],
        "annotation_coverage": X.ratio(F.col("typed"), F.col("annotatable")), "docstring_coverage": X.ratio(documented, public_units), "god_units": sum(gods[1:], gods[0]),
    }).drop("typed", "annotatable", "public_f", "public_c", "documented_f", "documented_c")


def test_proxies(files: DataFrame) -> DataFrame:
    """One row over all files; ratios are null where undefined. Generated files count only where they are tests."""
    f = files.where("parse_error is null and (is_test or not is_generated)")
    test, production = F.col("is_test"), ~F.col("is_test")
    sums = ("test_functions", "assertions", "assertion_free_tests", "production_functions", "with_doctest", "doctest_examples")
    row = f.agg(
        F.count_if(test).alias("test_files"), F.count_if(production).alias("production_files"),
        F.coalesce(F.sum(F.when(test, F.col("loc"))), F.lit(0)).alias("test_loc"), F.coalesce(F.sum(F.when(production, F.col("loc"))), F.lit(0)).alias("production_loc"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums),
    )
    c = F.col
    return row.withColumns({
        "test_code_ratio": X.open_ratio(c("test_loc"), c("production_loc")), "assertion_density": X.open_ratio(c("assertions"), c("test_functions")),
        "assertion_free_rate": X.open_ratio(c("assertion_free_tests"), c("test_functions")), "doctest_coverage": X.open_ratio(c("with_doctest"), c("production_functions")),
    })


def gates(rows: DataFrame, ceilings: dict[str, float]) -> DataFrame:
    """(profile, metric, value, ceiling) of every metric of the panel above its ceiling; no row means the gate is passed."""
    tried = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(v)).alias("ceiling")) for m, v in ceilings.items()]))
    return rows.select("profile", tried.alias("g")).select("profile", "g.*").where("value > ceiling")
