"""Rows of a Spark query and of DuckDB SQL, made comparable."""

import math


def value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    return round(float(v), 6) if isinstance(v, (int, float)) else str(v)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(value(r[n]) for n in names) for r in df.collect()), key=str)


def rows_of_duck(rel):
    names, at = sorted(rel.columns), {n: i for i, n in enumerate(rel.columns)}
    return names, sorted((tuple(value(r[at[n]]) for n in names) for r in rel.fetchall()), key=str)
