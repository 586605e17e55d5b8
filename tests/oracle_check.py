"""Compare registered queries with the SQL that states their result.

    python tests/oracle_check.py [folder] [name prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


LAPS: dict[str, float] = {}


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if hasattr(v, "asDict"):
        v = tuple(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if hasattr(v, "quantize"):
        return round(float(v), 9)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows), key=repr
    )


def difference(spark, folder, fn, sql, con=None) -> tuple[str | None, int]:
    start = time.time()
    df = fn(spark, folder)
    got_names, got = rows_of(df.columns, df.collect())
    LAPS["spark"] = time.time() - start
    if sql is None:
        return "no SQL states this result", len(got)
    start = time.time()
    res = (con or duck(folder)).execute(sql)
    want_names, want = rows_of([d[0] for d in res.description], res.fetchall())
    LAPS["sql"] = time.time() - start
    if got_names != want_names:
        return f"columns {got_names} != {want_names}", len(got)
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2] if len(got) < 200000 else []
        lacking = [r for r in want if r not in set(got)][:2] if len(got) < 200000 else []
        return f"rows {len(got)} != {len(want)}; only here {extra}; only there {lacking}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g.\n   {bad[0][0]}\n   {bad[0][1]}", len(got)
    return None, len(got)


def main() -> int:
    from docketflow.plans.all_queries import all_queries, all_sql
    from docketflow.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = tuple(sys.argv[2:])
    spark = build_session("oracle", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false", "docketflow.spread": "8",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    sql = all_sql()
    failed = 0
    for name, fn in all_queries().items():
        if wanted and not name.startswith(wanted):
            continue
        LAPS.update(spark=0.0, sql=0.0)
        try:
            problem, n = difference(spark, folder, fn, sql.get(name), con)
        except Exception as exc:  # report and go on to the next query
            problem, n = f"{type(exc).__name__}: {str(exc)[:700]}", -1
        state = "FAIL" if problem else ("ok" if name in sql else "ran")
        print(f"{state:4} {name:34} rows={n:7} {LAPS['spark']:6.2f}s sql {LAPS['sql']:6.2f}s {problem or ''}", flush=True)
        failed += bool(problem)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
