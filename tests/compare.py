"""Compare queries with their SQL: ``python tests/compare.py [sf_dir] [name ...]``."""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def comparable(row):
    return tuple((v is None, f"{v:.9g}" if isinstance(v, float) else str(v)) for v in row)


def difference(df, con, sql):
    """None when the rows are the same (in any order), else what differs; and the row count."""
    columns = sorted(df.columns)
    got = sorted(comparable(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    if sql is None:
        return None, len(got)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != columns:
        return f"columns {sorted(names)} != {columns}", len(got)
    order = [names.index(c) for c in columns]
    want = sorted(comparable([r[i] for i in order]) for r in cur.fetchall())
    if got == want:
        return None, len(got)
    extra = [r for r in got if r not in set(want)][:2]
    lack = [r for r in want if r not in set(got)][:2]
    return f"{len(got)} rows for {len(want)}\n  got  {extra}\n  want {lack}"[:1500], len(got)


def main():
    import __spark_entry__ as entry_points
    from labelgauge.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(entry_points.queries())
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), []
    for name in chosen:
        start = time.time()
        df = entry_points.queries()[name](spark, sf)
        wrong, n = difference(df, con, entry_points.oracle_sql().get(name))
        bad += [name] if wrong else []
        print(f"@ {name:32s} {time.time() - start:6.2f}s {n:7d} {wrong or 'ok'}", flush=True)
    print(f"@ {len(bad)} differ: {bad}")


if __name__ == "__main__":
    main()
