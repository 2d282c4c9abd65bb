"""Run a registered query and its SQL on the same tables and compare all values."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if v is None or isinstance(v, str | bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return int(v) if not isinstance(v, list | tuple) else tuple(_plain(x) for x in v)


def _canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=lambda r: tuple((v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in r))


def difference(df, con, sql: str) -> str | None:
    """None if both sides agree, else a short report."""
    got_cols, got = _canonical(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    want_cols, want = _canonical([c[0] for c in rel.description], rel.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first: {bad[0][0]} != {bad[0][1]}"
    kinds = [{type(v).__name__ for v in col if v is not None} for col in zip(*got, strict=True)]
    return None if all(len(k) <= 1 for k in kinds) else f"mixed types {kinds}"
