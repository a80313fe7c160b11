"""Prints what stands out in the plans of registered queries: nested-loop joins, windows without
keys, Python operators, exchanges.

    python tools/plans.py [--only name,name] [--full]
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rillstone.plans.catalog import QUERIES  # noqa: E402
from tools.check import session  # noqa: E402

MARKS = {
    "loop": r"BroadcastNestedLoopJoin|CartesianProduct",
    "single": r"Exchange SinglePartition",
    "python": r"PythonUDF|InPandas|BatchEvalPython|ArrowEvalPython",
    "exchange": r"\bExchange (?:hash|range|Round)",
    "reused": r"ReusedExchange",
    "scan": r"FileScan parquet",
    "limit": r"WindowGroupLimit",
}


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def main() -> None:
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="0.01")
    p.add_argument("--only", default="")
    p.add_argument("--full", action="store_true")
    a = p.parse_args()
    spark = session(8)
    spark.sparkContext.setLogLevel("OFF")
    for n in [x for x in a.only.split(",") if x] or list(QUERIES):
        df = QUERIES[n](spark, f"/root/testdata/sf{a.sf}")
        df.collect()
        text = plan_text(df)
        found = {k: len(re.findall(v, text)) for k, v in MARKS.items()}
        print(n, {k: v for k, v in found.items() if v}, flush=True)
        if a.full:
            print(text[:6000])
    spark.stop()


if __name__ == "__main__":
    main()
