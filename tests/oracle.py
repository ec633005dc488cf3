"""Spark's rows against DuckDB's: both as multisets of rows with columns in the order of their names."""

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, df.collect())


def sql_rows(sql, folder):
    connection = duckdb.connect()
    for table in TABLES:
        path = Path(folder, f"{table}.parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    relation = connection.execute(sql)
    names = [d[0] for d in relation.description]
    return sorted(names), rows_of(names, relation.fetchall())


def assert_same(df, sql, folder):
    names, got = spark_rows(df)
    wanted_names, wanted = sql_rows(sql, folder)
    assert names == wanted_names
    assert got == wanted, f"only Spark: {list((got - wanted).items())[:3]}; only SQL: {list((wanted - got).items())[:3]}"
    return sum(got.values())
