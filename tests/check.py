"""Compare registered queries with their SQL: python tests/check.py [SF_DIR] [name ...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else repr(float(f"{value:.9g}") + 0.0)
    if isinstance(value, bool):
        return value
    if hasattr(value, "tzinfo"):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short account of the difference."""
    got_cols, got = rows_of(spark_df.columns, spark_df.collect())
    result = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in result.description], result.fetchall())
    if got_cols != want_cols:
        return f"columns {sorted(set(got_cols) ^ set(want_cols))}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


def main() -> None:
    import __spark_entry__ as entry
    from bench import session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark, con = session(8), duck(sf_dir)
    sql, failed = entry.oracle_sql(), []
    for name, q in entry.queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            df = q(spark, sf_dir)
            if name in sql:
                verdict = compare(df, con, sql[name]) or "equal"
            else:
                verdict = f"no SQL, {df.count()} rows"
        except Exception as e:  # noqa: BLE001
            verdict = f"{type(e).__name__}: {str(e)[:600]}"
        if verdict != "equal" and not verdict.startswith("no SQL"):
            failed.append(name)
        print(f"{name:32s} {time.time() - began:6.2f}s  {verdict}", flush=True)
    print("FAILED", failed)


if __name__ == "__main__":
    main()
