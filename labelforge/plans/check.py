"""Side-by-side check of catalogue queries against their DuckDB oracle SQL.

Usage: ``python -m labelforge.plans.check [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import pandas as pd

from labelforge.sources.tables import TABLES


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _kind(series: pd.Series) -> str:
    """Coarse type of a column: int / float / bool / str / other (NULL-only: empty)."""
    vals = [v for v in series.tolist() if v is not None and not (isinstance(v, float) and math.isnan(v))]
    if not vals:
        return "empty"
    v = vals[0]
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int) or type(v).__name__.startswith("int"):
        return "int"
    if isinstance(v, float) or type(v).__name__.startswith("float"):
        return "float"
    if isinstance(v, str):
        return "str"
    return type(v).__name__


def canon(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in df.to_dict("records")]
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, sf_dir: str, name: str, con=None) -> dict:
    from labelforge.plans.catalog import ORACLE, QUERIES

    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = QUERIES[name](spark, sf_dir)
    s_pd = sdf.toPandas()
    t1 = time.time()
    res = {"name": name, "spark_rows": len(s_pd), "spark_sec": round(t1 - t0, 2)}
    if name not in ORACLE:
        res["status"] = "no-oracle"
        return res
    o_pd = con.sql(ORACLE[name]).df()
    res["oracle_rows"] = len(o_pd)
    if sorted(s_pd.columns) != sorted(o_pd.columns):
        res["status"] = f"columns differ: spark={sorted(s_pd.columns)} oracle={sorted(o_pd.columns)}"
        return res
    kinds = {c: (_kind(s_pd[c]), _kind(o_pd[c])) for c in s_pd.columns}
    dtypes = {c: (str(s_pd[c].dtype), str(o_pd[c].dtype)) for c in s_pd.columns}
    dtype_diff = {c: d for c, d in dtypes.items() if d[0] != d[1] and "empty" not in kinds[c]}
    if dtype_diff:
        res["status"] = f"dtypes differ: {dtype_diff}"
        return res
    bad_kinds = {c: k for c, k in kinds.items() if k[0] != k[1] and "empty" not in k}
    if bad_kinds:
        res["status"] = f"types differ: {bad_kinds}"
        return res
    a, b = canon(s_pd), canon(o_pd)
    if a == b:
        res["status"] = "match"
    else:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        res["status"] = f"values differ ({len(a)} vs {len(b)} rows): {diff}"
    return res


def main(argv: list[str]) -> int:
    from labelforge.plans.catalog import QUERIES
    from labelforge.session import get_spark

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = get_spark("local[8]", 8)
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, sf_dir, n, con)
        except Exception as e:  # report and keep going
            r = {"name": n, "status": f"error: {type(e).__name__}: {str(e)[:400]}"}
        ok = r["status"] in ("match", "no-oracle")
        bad += not ok
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
