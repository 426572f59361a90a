"""Compare registered queries with their SQL on the test tables.

Usage: python tests/oracle.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "tzinfo") and getattr(v, "tzinfo", None) is not None:
        return v.replace(tzinfo=None)
    return v


def _key(row):
    return tuple((v is None, str(type(v).__name__ in ("int", "float")), str(v)) for v in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=_key)


def same(a, b) -> bool:
    if a is None or b is None:
        return a is b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return a == b or abs(a - b) <= 2e-6
    return a == b


def compare(spark, con, query, sf_dir: str) -> str:
    """Empty text when equal, else the first difference; prefixed ``~`` when only rounding differs."""
    df = query.run(spark, sf_dir)
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if query.sql is None:
        return "" if got else "no rows"
    cur = con.execute(query.sql)
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        have, need = set(got), set(want)
        extra = [r for r in got if r not in need][:2], [r for r in want if r not in have][:2]
        return f"rows {len(got)} != {len(want)}; {extra}"
    if not got:
        return "no rows"
    kinds = [
        (n, type(a), type(b))
        for g, w in zip(got[:200], want[:200], strict=True)
        for n, a, b in zip(got_names, g, w, strict=True)
        if a is not None and b is not None and type(a) is not type(b)
    ]
    if kinds:
        return f"types differ: {kinds[0]}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    if not bad:
        return ""
    loose = [(g, w) for g, w in bad if not all(same(a, b) for a, b in zip(g, w, strict=True))]
    if not loose:
        return f"~ rounding in {len(bad)} rows, e.g. {bad[0]}"
    return f"{len(loose)} of {len(got)} rows differ: {got_names}\n   got  {loose[0][0]}\n   want {loose[0][1]}"


def main(args: list[str]) -> int:
    sys.path.insert(0, str(ROOT))
    from tidemark.queries import REGISTRY
    from tidemark.session import local_session

    sf = "0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    sf_dir = str(DATA / f"sf{sf}")
    spark, con = local_session(8), connect(sf_dir)
    names = [n for n in REGISTRY if not args or any(n.startswith(a) for a in args)]
    failed = 0
    for n in names:
        started = time.time()
        try:
            text = compare(spark, con, REGISTRY[n], sf_dir)
        except Exception as exc:  # noqa: BLE001
            text = f"{type(exc).__name__}: {str(exc)[:1500]}"
        failed += bool(text)
        print(f"{'ok  ' if not text else 'FAIL'} {n} {time.time() - started:.1f}s {text}", flush=True)
    print(f"{len(names) - failed} of {len(names)} match")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
