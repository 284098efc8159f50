"""Executed-plan summary of the headline queries (after AQE): scans with
their pruned read schema and pushed filters, exchanges, join strategies,
windows and whole-stage-codegen spans. Writes PLANS.md.

usage: python scripts/plan_report.py [sf_dir]
"""
import re
import sys

sys.path.insert(0, ".")
from bench import HEADLINE  # noqa: E402
from limnos.plans.catalog import QUERIES  # noqa: E402
from limnos.session import build_session  # noqa: E402


def final_plan(df) -> str:
    df.collect()  # headline results are small; this finalises the adaptive plan of df itself
    txt = df._jdf.queryExecution().executedPlan().toString()
    return txt.split("+- == Initial Plan ==")[0]


def summarise(name: str, plan: str) -> list[str]:
    out = [f"### `{name}`", ""]
    for line in plan.splitlines():
        if "FileScan parquet" in line:
            m_loc = re.search(r"InMemoryFileIndex\(\d+ paths\)\[([^\],]*)", line)
            m_pf = re.search(r"PushedFilters: \[([^\]]*)\]", line)
            m_rs = re.search(r"ReadSchema: (\S+)", line)
            src = m_loc.group(1).rsplit("/", 1)[-1] if m_loc else "?"
            out.append(f"- scan `{src}`: ReadSchema `{m_rs.group(1) if m_rs else '?'}`; "
                       f"PushedFilters `[{m_pf.group(1) if m_pf else ''}]`")
    counts = {
        "shuffle exchanges": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan)),
        "reused exchanges": plan.count("ReusedExchange"),
        "broadcast hash joins": plan.count("BroadcastHashJoin"),
        "sort-merge joins": plan.count("SortMergeJoin"),
        "nested-loop joins": plan.count("BroadcastNestedLoopJoin") + plan.count("CartesianProduct"),
        "window operators": len(re.findall(r"\bWindow \[", plan)),
        "scalar subqueries": len(re.findall(r"Subquery subquery", plan)),
        "codegen stages": len(set(re.findall(r"\*\((\d+)\)", plan))),
        "python UDF nodes": len(re.findall(r"(BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas)", plan)),
    }
    out.append("- " + ", ".join(f"{k}: {v}" for k, v in counts.items()))
    out.append("")
    return out


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session(master="local[8]", shuffle_partitions=16)
    lines = ["# Executed plans of the headline queries", "",
             f"Final (post-AQE) physical plans at `{sf}`, summarised by `scripts/plan_report.py`.",
             "Stage outputs that a query materialises (cleaned tables, day means of a global series)",
             "appear as scans of files under the checkpoint folder.", ""]
    for name in HEADLINE:
        lines += summarise(name, final_plan(QUERIES[name](spark, sf)))
    open("PLANS.md", "w").write("\n".join(lines) + "\n")
    print("\n".join(lines))


if __name__ == "__main__":
    main()
