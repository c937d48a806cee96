"""Summarise the physical plans of the headline queries (markdown on stdout).

For each query: scans with their ReadSchema / PushedFilters, and counts of
exchanges, joins by strategy, aggregates, windows and Python evaluations.
Plans are the ones AQE starts from (joins of small sides become broadcasts
at run time).  usage: python tools/plan_summary.py [sf_dir] > PLANS.md
"""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from weekpanel.plans import queries as Q  # noqa: E402
from weekpanel.session import local_session  # noqa: E402

HEADLINE = ["integrate_panel", "weekly_mean", "lag_features", "district_summary", "combine_parts", "complete_panel"]
COUNT = ["Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange SinglePartition", "BroadcastExchange",
         "SortMergeJoin", "BroadcastHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct", "HashAggregate",
         "SortAggregate", "ObjectHashAggregate", "Window", "Expand", "Generate", "BatchEvalPython", "ArrowEvalPython"]


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    print(f"# Physical plans of the headline queries ({os.path.basename(sf)})\n")
    print("Generated by `tools/plan_summary.py`. Scans list only the columns they read; the inputs of the")
    print("combine and panel steps are the Parquet tables the build writes once under `spark.checkpoint.dir`")
    print("(the two source aggregates below, and the combined daily cells). Exchange counts are before AQE, which")
    print("coalesces small partitions and turns joins with a small measured side into broadcasts at run time.\n")
    from weekpanel.plans import standin

    nations = standin.nation_dimension(spark, sf)
    sources = {
        "source: daily sheets (lineitem x supplier -> days x nations)": standin.daily_wide(spark, sf, nations, persist=False),
        "source: wide cases (orders x customer -> weeks x nations)": standin.cases_wide(spark, sf, nations, persist=False),
    }
    from weekpanel.plans import integrate

    weather = standin.inputs(spark, sf, cases=False, nations=nations)
    sources["combine: first row per date of all sheets -> cells (before it is written)"] = integrate.combine_inputs(weather, hold="none").cells
    for name, df in list(sources.items()) + [(n, None) for n in HEADLINE]:
        df = df if df is not None else getattr(Q, f"q_{name}")(spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"## `{name}`\n")
        counts = {k: len(re.findall(re.escape(k) + r"\b", plan)) for k in COUNT}
        print("| operator | count |\n| --- | --- |")
        for k, v in counts.items():
            if v:
                print(f"| {k} | {v} |")
        print()
        seen = set()
        for line in plan.splitlines():
            if "FileScan" not in line:
                continue
            loc = re.search(r"Location: \w+\(\d+ paths?\)\[([^\],]*)", line)
            pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", line)
            schema = re.search(r"ReadSchema: (struct<.*>)", line)
            path = os.path.basename(loc.group(1).rstrip("/")) if loc else "?"
            src = path if path.endswith(".parquet") else "materialized " + re.sub(r"-[0-9a-f]{12}$", "", path)
            key = (src, schema.group(1) if schema else "")
            if key in seen:
                continue
            seen.add(key)
            print(f"- scan `{src}`: ReadSchema `{key[1][:160]}`; PushedFilters `[{(pushed.group(1) if pushed else '')[:120]}]`")
        print()


if __name__ == "__main__":
    main()
