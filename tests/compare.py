"""Order-free comparison of a Spark result with a DuckDB result."""

import math


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def assert_same(rows, columns, cursor):
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(columns)
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in rows), key=repr)
    assert got == want
