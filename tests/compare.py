"""Order-free comparison of a Spark result with a DuckDB one."""

import datetime
import decimal
import math


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return None if math.isnan(v) else ("number", float(f"{v:.9g}"))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([plain(r[i]) for i in order]) for r in data)


def assert_same(df, relation):
    spark_columns, spark_rows = rows(df.columns, df.collect())
    duck_columns, duck_rows = rows(relation.columns, relation.fetchall())
    assert spark_columns == duck_columns
    assert spark_rows == duck_rows
