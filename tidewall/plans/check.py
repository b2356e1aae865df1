"""Compare registered queries with their DuckDB statements on the same parquet files."""

from __future__ import annotations

import math
import sys
import time

from tidewall.plans.views import TABLES


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(str(_cell(x)) for x in v) + "]"
    return str(v)


def _kind(t: str) -> str:
    t = t.lower()
    if t in ("tinyint", "smallint", "int", "integer", "bigint", "hugeint", "long"):
        return t
    return {"varchar": "string", "timestamp_ntz": "timestamp", "double precision": "double"}.get(t, t)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, sf_dir: str, name: str, fn, sql: str | None) -> tuple[bool, str]:
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(_cell(r[c]) for c in cols) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return True, f"rows={len(got)} spark={t1 - t0:.1f}s (no oracle)"
    con = duck(sf_dir)
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    types = {c[0]: _kind(str(c[1])) for c in rel.description}
    want_rows = rel.fetchall()
    t2 = time.time()
    if sorted(names) != cols:
        return False, f"columns {cols} vs {sorted(names)}"
    spark_types = {n: _kind(t) for n, t in df.dtypes}
    off = {c: (spark_types[c], types[c]) for c in cols if spark_types[c] != types[c]}
    idx = [names.index(c) for c in cols]
    want = [tuple(_cell(r[i]) for i in idx) for r in want_rows]
    note = f"rows={len(got)} spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s" + (f" types {off}" if off else "")
    key = lambda r: tuple("\0" if x is None else x for x in r)
    a, b = sorted(got, key=key), sorted(want, key=key)
    if a == b:
        return True, note
    extra = [r for r in a if r not in set(b)][:3]
    lack = [r for r in b if r not in set(a)][:3]
    return False, f"{note} spark rows {len(a)} duck rows {len(b)}\n   only spark: {extra}\n   only duck:  {lack}\n   cols {cols}"


def main(argv: list[str]) -> int:
    from tidewall.plans import catalog
    from tidewall.session import local_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    pick = argv[1:]
    catalog.load_all()
    spark = local_session(8)
    bad = 0
    for name, fn in catalog.QUERIES.items():
        if pick and not any(name.startswith(p) for p in pick):
            continue
        try:
            ok, note = compare(spark, sf, name, fn, catalog.ORACLES.get(name))
        except Exception as e:  # a failing query must not hide the others
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
