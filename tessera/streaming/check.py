"""Findings of a stream of files: the same stateless pass as over tables, so a stream needs no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources import stage


def payload_path(payload: F.Column) -> F.Column:
    """The file that a hook's JSON payload names."""
    return F.coalesce(F.get_json_object(payload, "$.tool_input.file_path"), F.get_json_object(payload, "$.file_path"))


def findings(sources: DataFrame) -> DataFrame:
    """(path, source) rows of a stream to findings of single files; suppressions do not apply, files that do not parse are clean."""
    rows = stage.parse(sources.where("path like '%.py'")).where("parse_error is null")
    return rows.select("path", F.explode("findings").alias("f")).select("path", "f.*")
