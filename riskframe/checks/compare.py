"""Side-by-side check of a Spark result against DuckDB SQL on the same parquet.

Mirrors the round check: column names sorted, row count, and an
order-insensitive hash of values (doubles rounded).
"""

from __future__ import annotations

import hashlib
import math

import duckdb
import pandas as pd

from riskframe.sources.tables import TABLES


def duck_connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits=6):
    if v is None:
        return "∅"
    try:
        if pd.isna(v):
            return "∅"
    except (TypeError, ValueError):
        pass
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return repr(float(int(v)))
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        try:
            f = float(v)
        except (TypeError, ValueError):
            return str(v)
        if math.isnan(f):
            return "∅"
        return repr(round(f, digits) + 0.0)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return str(v)


def frame_digest(pdf: pd.DataFrame, digits: int = 6) -> tuple[list[str], int, str]:
    cols = sorted(pdf.columns)
    rows = sorted("|".join(_norm(r[c], digits) for c in cols) for _, r in pdf[cols].iterrows())
    h = hashlib.sha256("\n".join(rows).encode()).hexdigest()
    return cols, len(rows), h


def compare(spark_df, sql: str, con, digits: int = 6) -> dict:
    s = spark_df.toPandas()
    d = con.sql(sql).df()
    sc, sn, sh = frame_digest(s, digits)
    dc, dn, dh = frame_digest(d, digits)
    out = {"cols_match": sc == dc, "rows_spark": sn, "rows_oracle": dn, "hash_match": sh == dh}
    if sc != dc:
        out["spark_cols"], out["oracle_cols"] = sc, dc
    if sh != dh and sc == dc:
        ss = set("|".join(_norm(r[c], digits) for c in sc) for _, r in s[sc].iterrows())
        ds = set("|".join(_norm(r[c], digits) for c in dc) for _, r in d[dc].iterrows())
        out["only_spark"] = sorted(ss - ds)[:3]
        out["only_oracle"] = sorted(ds - ss)[:3]
    return out
