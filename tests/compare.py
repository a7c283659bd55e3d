"""Compare a Spark result with its SQL answer, as sorted rows of the sorted columns."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), rows_of(df.columns, df.collect())


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    return sorted(columns), rows_of(columns, result.fetchall())


def difference(spark_side, duck_side) -> str | None:
    """None when equal, else a short description of the first difference."""
    (columns, left), (other, right) = spark_side, duck_side
    if columns != other:
        return f"columns {columns} against {other}"
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    different = [(a, b) for a, b in zip(left, right, strict=True) if repr(a) != repr(b)]
    if not different:
        return None
    a, b = different[0]
    cells = [(c, x, y) for c, x, y in zip(columns, a, b, strict=True) if repr(x) != repr(y)]
    return f"{len(different)} of {len(left)} rows; first {a[:3]}: {cells}"
