"""Print the executed (AQE final) plan of registered queries over stored tables.

Usage: python tools/explain.py [--sf DIR] [--grep] name [name ...]

With ``--grep`` only the lines that matter for scale are shown: scans with
their PushedFilters / PartitionFilters / ReadSchema, exchanges, join
strategies, window limits and top-k.
"""

from __future__ import annotations

import argparse
import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from circula.plans.catalog import BUILDERS  # noqa: E402
from circula.session import build_session  # noqa: E402
from circula.sources.stored import StoredTables, materialize  # noqa: E402

KEY = re.compile(r"(Scan |PushedFilters|PartitionFilters|ReadSchema|Exchange|Join|WindowGroupLimit|"
                 r"TakeOrderedAndProject|HashAggregate|Window \(|Generate)")


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--grep", action="store_true")
    ap.add_argument("names", nargs="+")
    args = ap.parse_args()
    spark = build_session()
    root = tempfile.mkdtemp(prefix="circula-explain-")
    materialize(spark, args.sf, root)
    t = StoredTables(spark, root, args.sf)
    for name in args.names:
        df = BUILDERS[name](t, spark)
        df.write.format("noop").mode("overwrite").save()
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        print(f"===== {name}")
        for line in plan.splitlines():
            if not args.grep or KEY.search(line):
                print(line)


if __name__ == "__main__":
    main()
