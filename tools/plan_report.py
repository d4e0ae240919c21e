"""Summarise the physical plan of every registered query (after execution, so adaptive
re-planning is final) into PLANS.md: shuffles, join strategies, Python nodes, top-N and
window limits, and what reaches the Parquet scans.

usage: python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusflow.plans.catalog import QUERIES  # noqa: E402
from corpusflow.session import build_session  # noqa: E402

JOINS = ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct")


def summarise(plan: str) -> dict:
    ops = re.findall(r"(?:\+-|:-|^)\s*([A-Za-z]+)", plan, flags=re.M)
    count = lambda name: sum(1 for o in ops if o == name)
    joins = [f"{j} x{count(j)}" for j in JOINS if count(j)]
    exch = count("Exchange")
    bcast = count("BroadcastExchange")
    py = [n for n in ("ArrowEvalPython", "MapInPandas", "FlatMapCoGroupsInPandas", "FlatMapGroupsInPandas") if count(n)]
    special = [n for n in ("TakeOrderedAndProject", "WindowGroupLimit", "Window", "HashAggregate", "Generate") if count(n)]
    pushed = sorted(set(re.findall(r"PushedFilters: \[([^\]]+)\]", plan)))
    return {"exchanges": exch, "broadcasts": bcast, "joins": ", ".join(joins) or "-", "python": ", ".join(py) or "-",
            "other": ", ".join(special) or "-", "pushed": "; ".join(pushed)[:120] or "-"}


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session(extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="plans-")})
    print("# Physical plans\n")
    print(f"Generated by `tools/plan_report.py` at `{sf_dir}` (final adaptive plans, `local[8]`). Checkpointed stages")
    print("appear as `Scan ExistingRDD`; their own plans ran when the checkpoint was taken.\n")
    print("| query | shuffles | broadcasts | joins | Python | top-N / windows / aggregates | pushed filters |")
    print("| --- | --- | --- | --- | --- | --- | --- |")
    for name in sorted(QUERIES):
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        s = summarise(df._jdf.queryExecution().executedPlan().toString())
        print(f"| `{name}` | {s['exchanges']} | {s['broadcasts']} | {s['joins']} | {s['python']} | {s['other']} | {s['pushed']} |")
    spark.stop()


if __name__ == "__main__":
    main()
