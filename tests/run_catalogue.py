"""Compare every registered query with its SQL twin: python tests/run_catalogue.py [sf_dir] [name...]"""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E  # noqa: E402
import harness  # noqa: E402
from paperloom.session import build_session  # noqa: E402


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("catalogue", os.environ.get("CATALOGUE_MASTER", "local[8]"), **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = harness.connect(folder)
    bad = 0
    for name, fn in E.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        started = time.time()
        try:
            df = fn(spark, folder)
            sql = E.oracle_sql().get(name)
            if sql:
                problem = harness.compare(df, con, sql)
            else:
                n = df.count()
                problem = None if n else "no rows"
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:700]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {'' if name in E.oracle_sql() else '(rows only) '}{time.time() - started:.2f}s {problem or ''}", flush=True)
    print(f"{bad} problem(s)")


main()
