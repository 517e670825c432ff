"""Run registered queries against their SQL and compare the values: ``python tests/oracle_check.py [sf] [names]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).parent.parent))

DATA = Path("/root/testdata")


KINDS = {
    "bigint": "int", "int": "int", "BIGINT": "int", "INTEGER": "int", "double": "float", "DOUBLE": "float",
    "string": "text", "VARCHAR": "text", "boolean": "bool", "BOOLEAN": "bool",
}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted((DATA / f"sf{sf}").glob("*.parquet")):
        con.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return str(value) if type(value).__name__ == "Decimal" else value


def normal(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, sf: str) -> str | None:
    """None if equal, else what differs."""
    from gleaner.plans.catalog import QUERIES
    from gleaner.plans.oracle import ORACLE

    df = QUERIES[name](spark, str(DATA / f"sf{sf}"))
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    result = con.sql(ORACLE[name])
    want = normal(result.columns, result.fetchall())
    if sorted(df.columns) != sorted(result.columns):
        return f"columns {df.columns} and {result.columns}"
    loose = {c: (t, str(dict(zip(result.columns, result.types))[c])) for c, t in df.dtypes}
    for column, (ours, theirs) in loose.items():
        if KINDS.get(ours, ours) != KINDS.get(theirs, theirs):
            print(f"  type of {name}.{column}: {ours} and {theirs}")
    if got != want:
        only = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
        return f"{len(got)} and {len(want)} rows; only in the first {only[0]}; only in the second {only[1]}"[:900]
    return None


if __name__ == "__main__":
    from conftest import session

    from gleaner.plans.oracle import ORACLE

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    spark, con = session(), connect(sf)
    bad = 0
    for name in sys.argv[2:] or ORACLE:
        start = time.time()
        try:
            problem = compare(spark, con, name, sf)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"{name:38s} {time.time() - start:6.1f}s {problem or 'ok'}", flush=True)
    print(f"{bad} differ")
    sys.exit(bool(bad))
