"""Run registered queries against their SQL in DuckDB on the same parquet files.

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float)):
        if isinstance(v, float) and math.isnan(v):
            return (1, "nan")
        return (1, repr(round(float(v), 6) + 0.0))
    if hasattr(v, "isoformat"):
        return (2, v.isoformat()[:19])
    if isinstance(v, (list, tuple)):
        return (3, str([_norm(x) for x in v]))
    if isinstance(v, (bytes, bytearray)):
        return (4, bytes(v).hex())
    return (5, str(v))


SAME_TYPE = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
    "date": "DATE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
}
TYPE_NOTES: list[str] = []


def compare(df, con, sql: str) -> str | None:
    """None when both results agree, else what differs."""
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(rows) != len(want):
        return f"{len(rows)} rows != {len(want)}"
    kinds = dict(df.dtypes)
    for name, want_type in ((d[0], str(d[1])) for d in cur.description):
        if SAME_TYPE.get(kinds[name], kinds[name]) != want_type:
            TYPE_NOTES.append(f"{name}: {kinds[name]} != {want_type}")
    order_a = [df.columns.index(c) for c in sorted(names)]
    order_b = [names.index(c) for c in sorted(names)]
    a = sorted([tuple(_norm(r[i]) for i in order_a) for r in rows])
    b = sorted([tuple(_norm(r[i]) for i in order_b) for r in want])
    for x, y in zip(a, b):
        if x != y:
            diff = [(c, p[1], q[1]) for c, p, q in zip(sorted(names), x, y) if p != q]
            return f"values differ, first: {diff[:4]}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from tests.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    chosen = sys.argv[2:] or list(queries)
    bad = 0
    for name in chosen:
        t = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                note = "" if problem is None else problem
                if TYPE_NOTES:
                    note += " [types " + "; ".join(TYPE_NOTES) + "]"
                    TYPE_NOTES.clear()
            else:
                problem, note = None, f"rows only: {df.count()}"
        except Exception as e:  # report and go on with the next query
            problem = note = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok':4} {name:28} {time.time() - t:6.2f}s {note}", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
