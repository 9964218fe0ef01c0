"""Run registered queries against their SQL: ``python tests/check_all.py [sf_dir] [name ...]``."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from parley.session import local_session  # noqa: E402
from tests import support  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else f"{support.TESTDATA}/sf0.01"
    names = sys.argv[2:]
    spark = local_session("8", spark__ui__showConsoleProgress="false")
    con = support.oracle(sf_dir)
    bad = 0
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = support.spark_rows(fn(spark, sf_dir))
            took = time.time() - start
            sql = entry.oracle_sql().get(name)
            gap = support.difference(got, support.sql_rows(con, sql)) if sql else "no sql"
            if gap not in (None, "no sql"):
                bad += 1
            print(f"{'ok  ' if gap is None else gap} {name} rows={len(got[1])} {took:.2f}s", flush=True)
        except Exception as error:  # report and go on with the next query
            bad += 1
            text = str(error).splitlines()[0][:300] if str(error) else repr(error)
            print(f"FAIL {name}: {text}", flush=True)
            if names:
                traceback.print_exc()
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
