"""Runs registered queries next to their SQL and compares rows, column names and types.

    python tests/oracle_check.py [sf_dir] [query ...]
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(con, df, sql):
    """None if equal, else a short description."""
    got = df.toArrow()
    want = con.sql(sql).to_arrow_table()
    names = sorted(got.column_names)
    if names != sorted(want.column_names):
        return f"columns {names} != {sorted(want.column_names)}"
    types = [(n, str(got.schema.field(n).type), str(want.schema.field(n).type)) for n in names]
    odd = [t for t in types if t[1].replace("large_", "") != t[2].replace("large_", "")]

    def rows(t):
        return sorted(zip(*[t.column(n).to_pylist() for n in names]), key=repr)

    a, b = rows(got), rows(want)
    if a != b:
        only = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        return f"rows {len(a)} != {len(b)} {names} {only}"
    return f"types {odd}" if odd else None


if __name__ == "__main__":
    from homestream.plans.oracles import ORACLES
    from homestream.plans.queries import QUERIES
    from homestream.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con = local_session(), connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(con, QUERIES[name](spark, sf_dir), ORACLES[name]) if name in ORACLES else "no SQL"
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")
