"""Compare every registered query with its SQL twin.

``python tests/harness.py [sf] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def canonical(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if hasattr(value, "as_integer_ratio") and not isinstance(value, int):
        return float(value)
    return value


def table_rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canonical(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(spark, con, folder: str, name: str, fn, sql: str | None) -> tuple[bool, str]:
    df = fn(spark, folder)
    cols, got = table_rows([tuple(r) for r in df.collect()], df.columns)
    if sql is None:
        return bool(got), f"{len(got)} rows (no SQL)"
    res = con.execute(sql)
    wcols, want = table_rows(res.fetchall(), [c[0] for c in res.description])
    if cols != wcols:
        return False, f"columns {cols} != {wcols}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}; first {got[:2]} vs {want[:2]}"
    for g, w in zip(got, want):
        if g != w:
            bad = sum(a != b for a, b in zip(got, want))
            return False, f"{bad} rows differ, first {dict(zip(cols, g))} != {dict(zip(cols, w))}"
        if [type(a) for a in g] != [type(a) for a in w] and None not in g:
            return False, f"types {[type(a).__name__ for a in g]} != {[type(a).__name__ for a in w]}"
    return bool(got), f"{len(got)} rows"


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from strandlab.session import build_session

    sf = argv[0] if argv else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = build_session("harness", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    if argv[1:] and argv[1].endswith("*"):
        names = [q for q in queries if q.startswith(argv[1][:-1])]
    failed = []
    for name in names:
        begin = time.time()
        try:
            ok, text = compare(spark, con, folder, name, queries[name], sql.get(name))
        except Exception as error:  # noqa: BLE001
            ok, text = False, f"{type(error).__name__}: {str(error)[:900]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - begin:.1f}s {text[:1100]}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(names) - len(failed)}/{len(names)} ok; failed: {failed}")
    return len(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
