"""Compare a query with its SQL text on the same tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 7)
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    return str(value) if hasattr(value, "isoformat") or type(value).__name__ == "Decimal" else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty if names and rows agree."""
    df = query(spark, sf_dir)
    want = con.sql(sql)
    if sorted(df.columns) != sorted(want.columns):
        return f"columns {sorted(df.columns)} and {sorted(want.columns)}"
    a, b = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(want.columns, want.fetchall())
    if a == b:
        return ""
    left, right = [x for x in a if x not in set(b)], [x for x in b if x not in set(a)]
    return f"{len(a)} and {len(b)} rows; only in Spark {left[:3]}; only in SQL {right[:3]}"
