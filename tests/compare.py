"""Hold a query's rows against its DuckDB SQL."""

from __future__ import annotations

import math
import tempfile
from collections import Counter
from pathlib import Path

import duckdb
import pyarrow as pa

from loamgrid.plans.fixtures import GIVEN


def database(sf_dir: str, spill: str | None = None) -> duckdb.DuckDBPyConnection:
    """A database of its own over the given tables, within bounds, so that one that fails takes no other with it."""
    db = duckdb.connect(config={"memory_limit": "4GB", "threads": 4, "temp_directory": spill or tempfile.mkdtemp(prefix="duckdb-")})
    for t in GIVEN:
        path = Path(f"{sf_dir}/{t}.parquet")
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return db


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 4) + 0.0
    if hasattr(value, "is_integer") or type(value).__name__ == "Decimal":
        return round(float(value), 4) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def _kind(t: pa.DataType) -> str:
    for name, test in (("int", pa.types.is_integer), ("float", pa.types.is_floating), ("string", lambda x: pa.types.is_string(x) or pa.types.is_large_string(x)), ("list", pa.types.is_list), ("time", pa.types.is_timestamp)):
        if test(t):
            return name
    return str(t)


def differences(query, sql: str, spark, sf_dir: str, db: duckdb.DuckDBPyConnection) -> list[str]:
    """What differs: columns, kinds of types, rows."""
    got, want = query(spark, sf_dir).toArrow(), db.execute(sql).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return [f"columns {sorted(got.column_names)} against {sorted(want.column_names)}"]
    names = sorted(got.column_names)
    found = [f"{n}: {got.schema.field(n).type} against {want.schema.field(n).type}" for n in names if _kind(got.schema.field(n).type) != _kind(want.schema.field(n).type)]
    a, b = (Counter(zip(*(map(_plain, t[n].to_pylist()) for n in names), strict=True)) for t in (got, want))
    if a != b:
        found.append(f"{sum(a.values())} rows against {sum(b.values())}; only here {list((a - b).items())[:3]}; only there {list((b - a).items())[:3]}")
    return found
