"""Run registered queries on Spark and their SQL on DuckDB; print every difference.

    python tests/oracle_check.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    out = []
    for row in df.itertuples(index=False):
        out.append(tuple("NULL" if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)) else
                         (repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else
                          (repr(v.item()) if hasattr(v, "item") and not isinstance(v, pd.Timestamp) and False else str(v)))
                         for v in row))
    return sorted(out)


def norm(df: pd.DataFrame) -> pd.DataFrame:
    for c in df.columns:
        if str(df[c].dtype).startswith(("int", "Int", "float", "uint", "Float")):
            df[c] = df[c].astype("float64")
        elif str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str).str.replace(" 00:00:00", "")
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda v: str(v).replace(" 00:00:00", "") if v is not None and not isinstance(v, float) else v)
    return df


def compare(name, spark, queries, oracle, con, sf_dir) -> tuple[bool, str]:
    t = time.time()
    sdf = queries[name](spark, sf_dir)
    got = sdf.toPandas()
    took = time.time() - t
    if name not in oracle:
        return True, f"rows={len(got)} (no sql) {took:.1f}s"
    want = con.sql(oracle[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    kinds = [(c, str(got[c].dtype), str(want[c].dtype)) for c in sorted(got.columns)
             if str(got[c].dtype) != str(want[c].dtype) and not {str(got[c].dtype), str(want[c].dtype)} <= {"datetime64[ns]", "datetime64[us]", "object"}]
    if len(got) != len(want):
        return False, f"rows {len(got)} vs {len(want)} {took:.1f}s"
    a, b = canon(norm(got)), canon(norm(want))
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} of {len(a)} rows differ, e.g.\n   {sorted(got.columns)}\n   spark {bad[0][0]}\n   sql   {bad[0][1]}"
    return True, f"rows={len(got)} {took:.1f}s" + (f"  DTYPES {kinds}" if kinds else "") + ("  EMPTY" if not len(got) else "")


def main(argv):
    sf = "0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    import __spark_entry__ as entry
    from tidemark.session import local_session
    spark = local_session()
    sf_dir = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    queries, oracle = entry.queries(), entry.oracle_sql()
    fails = []
    for name in queries:
        if argv and not any(name.startswith(p) for p in argv):
            continue
        try:
            ok, msg = compare(name, spark, queries, oracle, con, sf_dir)
        except Exception as e:  # noqa: BLE001 - report and go on
            ok, msg = False, f"{type(e).__name__}: {str(e)[:600]}"
        print(("ok   " if ok else "FAIL ") + name, msg, flush=True)
        if not ok:
            fails.append(name)
    print(len(fails), "failing:", fails)


if __name__ == "__main__":
    main(sys.argv[1:])
