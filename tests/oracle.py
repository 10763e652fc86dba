"""Run registered queries beside their SQL in DuckDB and compare whole results.

Command line: python tests/oracle.py [--sf 0.01] [name prefix ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    return str(v)


def _rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def spark_rows(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def compare(df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    kinds = {
        "bigint": {"BIGINT", "NUMBER"}, "int": {"INTEGER", "NUMBER"}, "double": {"DOUBLE", "NUMBER"},
        "float": {"FLOAT", "NUMBER"}, "string": {"VARCHAR", "STRING"}, "boolean": {"BOOLEAN", "bool"},
    }
    for n, t in df.dtypes:
        if types[n] not in kinds.get(t, set()):
            return f"type of {n}: {t} != {types[n]}"
    got = _rows(df.columns, spark_rows(df))
    expected = _rows(names, want)
    if got != expected:
        extra = [r for r in got if r not in set(expected)][:3]
        missing = [r for r in expected if r not in set(got)][:3]
        return f"{len(got)} rows != {len(expected)}; only here {extra}; only in SQL {missing}; columns {sorted(names)}"
    if not got:
        return "both empty"
    return None


def main(argv: list[str]) -> int:
    from runledger.plans import catalog
    from runledger.session import local_session

    sf = "0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    sf_dir = f"{DATA}/sf{sf}"
    spark = local_session(8)
    con = connect(sf_dir)
    bad = 0
    for name in catalog.QUERIES:
        if argv and not any(name.startswith(p) for p in argv):
            continue
        start = time.time()
        try:
            df = catalog.QUERIES[name](spark, sf_dir)
            sql = catalog.ORACLES.get(name)
            problem = f"no SQL, {df.count()} rows" if sql is None else compare(df, con, sql)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        ok = problem is None or problem.startswith("no SQL")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
