"""Compare a registered query with its SQL on the same parquet files."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, db, query, sql, sf_dir):
    """Problems found, an empty list when both sides agree; and the row count."""
    df = query(spark, sf_dir)
    got = df.collect()
    found = db.execute(sql)
    types = {d[0]: str(d[1]) for d in found.description}
    names = list(types)
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"], len(got)
    want = rows_of(names, found.fetchall())
    have = rows_of(df.columns, got)
    problems = [] if len(have) == len(want) else [f"{len(have)} rows against {len(want)}"]
    spark_types = dict(df.dtypes)
    same = {"BIGINT": "bigint", "VARCHAR": "string", "BOOLEAN": "boolean", "INTEGER": "int", "DOUBLE": "double"}
    problems += [f"type of {n}: {spark_types[n]} against {t}" for n, t in types.items() if same.get(t) != spark_types[n]]
    different = [(h, w) for h, w in zip(have, want) if h != w or [type(x) for x in h] != [type(x) for x in w]]
    problems += [f"{len(different)} rows differ, first {pair}" for pair in different[:1]]
    return problems, len(got)


if __name__ == "__main__":
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from ledgermark import catalog
    from ledgermark.session import local_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    session = local_session("oracle", "8", 8)
    database = connect(sf)
    sqls = catalog.oracle_sql()
    for key, fn in catalog.queries().items():
        if wanted and key not in wanted:
            continue
        start = time.time()
        try:
            if key in sqls:
                problems, n = compare(session, database, fn, sqls[key], sf)
            else:
                problems, n = [], len(fn(session, sf).collect())
            print(f"{key:26} {n:8} rows {time.time() - start:6.1f}s", "ok" if not problems else "; ".join(problems)[:900], flush=True)
        except Exception as error:  # noqa: BLE001
            print(f"{key:26} ERROR {str(error)[:900]}", flush=True)
