"""Comparison of a query with SQL run by another engine on the same files."""

import math
import os

import duckdb


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(canonical, value))
    return value


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(canonical(r[c]) for c in names) for r in df.collect()), key=repr)


def expected(con, sql):
    relation = con.sql(sql)
    names = sorted(relation.columns)
    order = [relation.columns.index(c) for c in names]
    return names, sorted((tuple(canonical(r[i]) for i in order) for r in relation.fetchall()), key=repr)
