"""Look for plan shapes that do not scale: ``python tests/explain_all.py [sf_dir] [name ...]``."""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from parley.session import local_session  # noqa: E402
from tests import support  # noqa: E402


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


SUSPECT = {
    "cartesian": r"CartesianProduct",
    "nested loop": r"BroadcastNestedLoopJoin",
    "single-task window": r"Exchange SinglePartition[^\n]*\n[^\n]*(?:Project|Sort|Window)[^\n]*\n",
}


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else f"{support.TESTDATA}/sf0.001"
    names = sys.argv[2:]
    spark = local_session("8", spark__ui__showConsoleProgress="false")
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        plan = plan_of(fn(spark, sf_dir))
        found = [k for k, p in SUSPECT.items() if re.search(p, plan)]
        windows = re.findall(r"Window \[[^\n]*", plan)
        bare = [w for w in windows if re.search(r"\], \[\w+#\d+L? (?:ASC|DESC)[^\]]*\]$", w) is None]
        exchanges = len(re.findall(r"Exchange (?:hash|range|round)", plan))
        print(f"{name}: exchanges={exchanges} {found or ''}", flush=True)
        if names:
            print(plan)


if __name__ == "__main__":
    main()
