"""Runs registered queries beside their checking SQL and compares every value.

    python tests/compare.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return float(value) if abs(value) < 2**53 else value
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain_rows = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain_rows, key=lambda r: tuple((v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in r))


def spark_types(df):
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


SAME = {
    "int": {"INTEGER"}, "bigint": {"BIGINT"}, "string": {"VARCHAR"}, "double": {"DOUBLE"}, "boolean": {"BOOLEAN"},
    "timestamp": {"TIMESTAMP"}, "smallint": {"SMALLINT"},
}


def compare(spark, connection, sf_dir, name, query, sql):
    start = time.time()
    df = query(spark, sf_dir)
    types = spark_types(df)
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    seconds = time.time() - start
    if sql is None:
        return f"rows-only {len(got)} rows", seconds, bool(got)
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    sql_types = {d[0]: str(d[1]) for d in cursor.description}
    want_columns, want = rows_of(names, cursor.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}", seconds, False
    off = {c: (types[c], sql_types[c]) for c in types if sql_types[c] not in SAME.get(types[c], ())}
    if len(got) != len(want):
        only_got = [r for r in got if r not in set(want)][:2]
        only_want = [r for r in want if r not in set(got)][:2]
        return f"rows {len(got)} != {len(want)} got {only_got} want {only_want}", seconds, False
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {got_columns}: {bad[0]}", seconds, False
    return f"{len(got)} rows" + (f" TYPES {off}" if off else ""), seconds, not off and bool(got)


def main():
    from normtext.plans import catalog
    from normtext.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="compare-"), spark__normtext__scanTasks="16",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    queries, sql = catalog.queries(), catalog.oracle_sql()
    failed = 0
    for name, query in queries.items():
        if names and not any(n in name for n in names):
            continue
        try:
            note, seconds, ok = compare(spark, connection, sf_dir, name, query, sql.get(name))
        except Exception as error:  # noqa: BLE001 - report and go on
            note, seconds, ok = f"{type(error).__name__}: {str(error)[:1500]}", 0.0, False
            if os.environ.get("TRACE"):
                traceback.print_exc()
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {seconds:6.2f}s {note}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
