"""Runs registered queries on the smallest tables, several at a time, and compares them with their SQL."""

import math
import os
from concurrent.futures import ThreadPoolExecutor

import duckdb

TABLES = "/root/testdata/sf0.001"


def _plain(value):
    if isinstance(value, float):
        return ("nan",) if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def _rows(table):
    names = sorted(table.column_names)
    return names, sorted((tuple(_plain(r[n]) for n in names) for r in table.to_pylist()), key=repr)


def failures(spark, queries, sql):
    """By name, what is wrong: a query's error, other columns or other rows than its SQL has."""

    def one(name):
        try:
            names, rows = _rows(queries[name](spark, TABLES).toArrow())
            if name in sql:
                with duckdb.connect() as con:
                    for f in os.listdir(TABLES):
                        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{f}'")
                    other, expected = _rows(con.sql(sql[name]).to_arrow_table())
                if names != other:
                    return name, f"columns {names}, {other}"
                if rows != expected:
                    return name, f"{len(rows)} rows, {len(expected)} expected, {next(((a, b) for a, b in zip(rows, expected) if a != b), None)}"  # noqa: B905
        except Exception as e:  # noqa: BLE001
            return name, repr(e)[:500]
        return None

    with ThreadPoolExecutor(4) as pool:
        return dict(filter(None, pool.map(one, queries)))
