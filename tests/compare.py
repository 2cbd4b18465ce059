"""Spark rows against DuckDB rows, in any order."""

import math


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v) if v is not None else None


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=str)


def same(df, relation):
    columns, other = df.columns, relation.columns
    assert sorted(columns) == sorted(other)
    assert rows_of(columns, [tuple(r) for r in df.collect()]) == rows_of(other, relation.fetchall())
