"""Run registered queries next to their SQL and report differences.

    python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        raise TypeError(f"decimal in a result: {value}")
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(([_plain(r[i]) for i in order] for r in rows), key=repr)


FAMILIES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE",
}


def difference(df, con, sql) -> str | None:
    """None when the DataFrame and the SQL give the same rows, else what differs."""
    result = con.execute(sql)
    types = {d[0]: str(d[1]).upper() for d in result.description}
    want_names, want = _table([d[0] for d in result.description], result.fetchall())
    got_names, got = _table(df.columns, [tuple(r) for r in df.collect()])
    if got_names != want_names:
        return f"columns {got_names} / {want_names}"
    wrong = {
        f.name: (f.dataType.simpleString(), types[f.name]) for f in df.schema.fields
        if FAMILIES.get(f.dataType.simpleString()) != types[f.name]
    }
    if len(got) != len(want):
        return f"{len(got)} rows / {len(want)}"
    rows = [(g, w) for g, w in zip(got, want) if repr(g) != repr(w)]
    if rows:
        return f"{len(rows)} of {len(got)} rows, first {rows[0]} types {wrong}"
    return f"types {wrong}" if wrong else None


def main() -> int:
    import __spark_entry__ as entry
    from punctual.session import build_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = build_session(
        "compare", f"local[{os.environ.get('BENCH_CPUS', '8')}]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, statements = entry.queries(), entry.oracle_sql()
    assert set(statements) <= set(queries), set(statements) - set(queries)
    failed = 0
    for name in args or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in statements:
                problem = difference(df, con, statements[name])
                outcome = "same" if problem is None else f"DIFFERENT {problem}"
            else:
                outcome = f"no SQL, {len(df.collect())} rows"
        except Exception as error:  # noqa: BLE001 - reported per query
            outcome = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        failed += outcome.startswith(("DIFF", "ERROR"))
        print(f"{name:32} {time.time() - start:6.2f}s {outcome}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(min(main(), 1))
