"""Run a query and its SQL counterpart on the same tables and compare schema and values."""

from __future__ import annotations

import duckdb
import pyarrow as pa

from checks.registry import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _kind(t: pa.DataType) -> str:
    if pa.types.is_string(t) or pa.types.is_large_string(t):
        return "string"
    if pa.types.is_timestamp(t):
        return "timestamp"
    return str(t)


def _rows(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return sorted(zip(*columns), key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


def differences(ours: pa.Table, theirs: pa.Table) -> list[str]:
    found = []
    kinds = [{n: _kind(t.schema.field(n).type) for n in t.column_names} for t in (ours, theirs)]
    if kinds[0] != kinds[1]:
        found.append(f"schema: {sorted(set(kinds[0].items()) ^ set(kinds[1].items()))}")
    if ours.num_rows != theirs.num_rows:
        found.append(f"rows: {ours.num_rows} and {theirs.num_rows}")
    if sorted(ours.column_names) != sorted(theirs.column_names):
        return found
    a, b = _rows(ours), _rows(theirs)
    bad = [(x, y) for x, y in zip(a, b) if repr(x) != repr(y)]
    if bad:
        found.append(f"values: {len(bad)} rows differ, first {str(bad[0])[:500]}")
    return found
