"""Tables written once below ``spark.checkpoint.dir``: lineage is cut there, and every executor can read them again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_own: list[str] = []
_made: list[str] = []


#: Shuffle files of a finished write are of no more use; with this setting Spark drops them at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as written to the shared folder and read back; on a local master a temporary folder where the session names none (tests)."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="tessera-"))
        folder = _own[0]
    path = f"{folder.rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"
    _made.append(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """``written``, and aggregates of its rows taken while they are written, without another job."""
    seen = Observation()
    table = written(df.observe(seen, *[c.alias(k) for k, c in counts.items()]), name)
    return table, seen.get


def forget(spark: SparkSession) -> int:
    """Delete every table that this process has written here, once what was made of them is written elsewhere; how many."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    done = len(_made)
    while _made:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made.pop())
        place.getFileSystem(conf).delete(place, True)
    return done
