"""Row comparison of a Spark result with its SQL twin, column order ignored."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def _rows(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in at) for r in rows), key=lambda r: tuple(map(repr, r)))


def difference(df, con, sql: str) -> str | None:
    """None when the results agree, else what differs."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    expected = cur.fetchall()
    got = df.collect()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = _rows(df.columns, got), _rows(names, expected)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, e.g.\n  spark {bad[0][0]}\n  sql   {bad[0][1]}"
    return None


_SPARK = {"int": "whole", "bigint": "whole", "string": "text", "double": "real", "boolean": "flag", "timestamp_ntz": "time"}
_DUCK = {"INTEGER": "whole", "BIGINT": "whole", "VARCHAR": "text", "DOUBLE": "real", "BOOLEAN": "flag", "TIMESTAMP": "time"}


def type_differences(df, con, sql: str) -> list[str]:
    """Columns whose kinds of value differ between the two results."""
    duck = {r[0]: r[1] for r in con.execute(f"describe {sql}").fetchall()}
    return [f"{c}: {t} / {duck.get(c)}" for c, t in df.dtypes if _SPARK.get(t, t) != _DUCK.get(duck.get(c))]
