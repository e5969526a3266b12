"""Compare a registered query with its SQL twin on the same parquet tables."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

from slopeline.catalog import QUERIES, run
from slopeline.catalog.registry import TABLES


def _plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, decimal.Decimal):
        return ("decimal", v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([_plain(r[i]) for i in order] for r in rows), key=repr)


def twin(name: str, folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    rel = con.execute(QUERIES[name].sql)
    types = {d[0]: str(d[1]) for d in rel.description}
    return types, rel.fetchall()


def compare(name: str, spark, folder: str) -> list[str]:
    """Differences, empty when names, counts and values agree."""
    df = run(name, spark, folder)
    got_cols, got = df.columns, df.collect()
    types, want = twin(name, folder)
    problems = []
    if sorted(got_cols) != sorted(types):
        return [f"columns {sorted(got_cols)} != {sorted(types)}"]
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    ok = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
          "boolean": "BOOLEAN", "date": "DATE", "float": "FLOAT"}
    for c, s in spark_types.items():
        if s in ok and ok[s] != types[c]:
            problems.append(f"type of {c}: {s} != {types[c]}")
    a, b = _rows(got_cols, got), _rows(list(types), want)
    if len(a) != len(b):
        problems.append(f"rows {len(a)} != {len(b)}")
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        problems.append(f"{len(bad)} of {len(a)} rows differ, first:\n   {bad[0][0]}\n   {bad[0][1]}")
    return problems
