"""Run queries and their oracles side by side: ``python -m catalog.compare <folder> [name ...]``."""

from __future__ import annotations

import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    if value is None:
        return ("", "")
    if isinstance(value, bool):
        return ("b", str(value))
    if isinstance(value, (int, float)):
        return ("n", repr(float(value)))
    if type(value).__name__ == "Decimal":
        return ("n", repr(float(value)))
    return ("s", str(value))


def _normal(columns: list[str], rows: list) -> tuple[list[str], list]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def oracle_connection(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(spark, con, folder: str, name: str) -> str:
    """Empty when query and oracle agree, else what differs."""
    from catalog.all import ORACLES, QUERIES

    df = QUERIES[name](spark, folder)
    rows = df.collect()
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if name not in ORACLES:
        return "" if rows else "no rows"
    result = con.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    kinds = {c[0]: str(c[1]) for c in result.description}
    expected = result.fetchall()
    a, b = _normal(df.columns, rows), _normal(names, expected)
    if a[0] != b[0]:
        return f"columns {a[0]} != {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"rows {len(a[1])} != {len(b[1])}"
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}
    wrong = {c: (types[c], kinds[c]) for c in names if pairs.get(types[c]) != kinds[c]}
    if wrong:
        return f"types {wrong}"
    if not rows:
        return "no rows"
    for x, y in zip(a[1], b[1]):
        if x != y:
            n = len(set(a[1]) - set(b[1]))
            return f"{n} of {len(rows)} rows differ, first:\n   spark  {x}\n   oracle {y}\n   columns {a[0]}"
    return ""


def main() -> None:
    from catalog.all import ORACLES, QUERIES
    from quoin.session import local_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session("compare")
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(folder)
    bad = 0
    for name in wanted or QUERIES:
        start = time.time()
        try:
            problem = compare(spark, con, folder, name)
        except Exception as error:  # noqa: BLE001 - every failure is reported, none stops the run
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        mark = "ok  " if not problem else "FAIL"
        bad += bool(problem)
        kind = "" if name in ORACLES else " (rows only)"
        print(f"{mark} {time.time() - start:6.2f}s {name}{kind} {problem}", flush=True)
    print(f"{bad} problems in {len(wanted or QUERIES)} queries")


if __name__ == "__main__":
    main()
