"""Compare registered queries with their SQL: python tests/check_queries.py [sf] [name part ...]

With SHUFFLE_JOINS=1 Spark broadcasts nothing on its own, as with large tables.
"""

import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

import oracle  # noqa: E402
import __spark_entry__ as entry  # noqa: E402
from answerloom.session import local_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = local_session(shared=tempfile.mkdtemp(prefix="check-"))
    if os.environ.get("SHUFFLE_JOINS"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    con = oracle.connect(folder)
    sql = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            if name in sql:
                problem = oracle.compare(df, con, sql[name])
                n = "sql"
            else:
                problem, n = None, f"rows={df.count()}"
        except Exception as error:  # report and go on with the next query
            problem, n = f"{type(error).__name__}: {str(error)[:1500]}", "error"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} [{n}] {time.time() - start:.1f}s", flush=True)
        if problem:
            print("    " + problem, flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
