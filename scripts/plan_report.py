"""Summarize the final adaptive plan of every registered query of the library itself (writes PLANS.md
content to stdout; the training-data operators run several jobs and are left to the check tool).

Usage: python scripts/plan_report.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marksheet.plans import catalog  # noqa: E402
from marksheet.session import build_session  # noqa: E402

SKIP = ("m1_", "v8_rebalance_over")  # streaming and the batch loop run several jobs


def summary(plan: str) -> dict:
    plan = plan.split("== Initial Plan ==")[0]  # the final adaptive plan only
    return {
        "hash": len(re.findall(r"Exchange hashpartitioning", plan)),
        "range": len(re.findall(r"Exchange rangepartitioning", plan)),
        "single": len(re.findall(r"Exchange SinglePartition", plan)),
        "rr": len(re.findall(r"Exchange RoundRobinPartitioning", plan)),
        "bcast": len(re.findall(r"BroadcastExchange", plan)),
        "reused": len(re.findall(r"ReusedExchange", plan)),
        "wgl": "yes" if "WindowGroupLimit" in plan else "",
        "topn": "yes" if "TakeOrderedAndProject" in plan else "",
        "subq": "yes" if "Subquery subquery" in plan else "",
    }


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]")
    print("| query | hash exch. | range exch. | single-partition exch. | round-robin | broadcast | reused | partial limit | top-n | scalar subquery |")
    print("|---|---|---|---|---|---|---|---|---|---|")
    for name, fn in catalog.QUERIES.items():
        if name.startswith(SKIP):
            continue
        df = fn(spark, sf)
        df.collect()
        s = summary(df._jdf.queryExecution().executedPlan().toString())
        print(f"| `{name}` | {s['hash']} | {s['range']} | {s['single']} | {s['rr']} | {s['bcast']} | {s['reused']} | {s['wgl']} | {s['topn']} | {s['subq']} |")


if __name__ == "__main__":
    main()
