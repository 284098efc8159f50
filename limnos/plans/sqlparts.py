"""Builders for the DuckDB oracle SQL (plain ANSI + DuckDB list/`qualify`).

The oracle is written independently of the Spark operators: straight
window functions over whole series, as the reference computes them.
"""

from __future__ import annotations


def r6(expr: str, alias: str | None = None) -> str:
    return f"round(cast({expr} as double), 6) as {alias or expr}"


def daily(src: str, key: str | None, ts: str, measures: dict[str, str], name: str) -> str:
    """CTE pair `<name>_day`, `<name>`: daily means on a full calendar per key."""
    k_sel = f"{key} as location, " if key else ""
    k_grp = "location, " if key else ""
    avgs = ", ".join(f"avg({expr}) as {m}" for m, expr in measures.items())
    m_sel = ", ".join(f"d.{m}" for m in measures)
    grid_key = "location, " if key else ""
    grp_by = "group by location" if key else ""
    on = "g.location = d.location and g.\"timestamp\" = d.\"timestamp\"" if key else "g.\"timestamp\" = d.\"timestamp\""
    return f"""{name}_day as (select {k_sel}cast({ts} as date) as "timestamp", {avgs} from {src} group by {k_grp}"timestamp"),
{name}_grid as (select {grid_key}cast(unnest(generate_series(min("timestamp"), max("timestamp"), interval 1 day)) as date) as "timestamp" from {name}_day {grp_by}),
{name} as (select {'g.location, ' if key else ''}g."timestamp", {m_sel} from {name}_grid g left join {name}_day d on {on})"""


def fill(src: str, key: str | None, measures: list[str], name: str, keep_raw: bool = False) -> str:
    part = "partition by location " if key else ""
    w_run = f"over ({part}order by \"timestamp\" rows between unbounded preceding and current row)"
    w_all = f"over ({part}order by \"timestamp\" rows between unbounded preceding and unbounded following)"
    exprs = ", ".join(
        f"coalesce(last_value({m} ignore nulls) {w_run}, first_value({m} ignore nulls) {w_all}) as {m}"
        for m in measures)
    raw = (", " + ", ".join(f"{m} as {m}_raw" for m in measures)) if keep_raw else ""
    k = "location, " if key else ""
    return f"{name} as (select {k}\"timestamp\"{raw}, {exprs} from {src})"


def zfilter(src: str, key: str | None, measures: list[str], name: str, constant: str = "keep") -> str:
    part = "partition by location" if key else ""
    conds = []
    for m in measures:
        z = f"abs(({m} - avg({m}) over ({part})) / nullif(stddev_pop({m}) over ({part}), 0)) < 3"
        if constant == "keep":
            conds.append(f"coalesce({z}, true)")
        else:
            conds.append(f"({m} is null or coalesce({z}, false))")
    return f"{name} as (select * from {src} qualify {' and '.join(conds)})"


def minmax(src: str, key: str | None, measures: list[str], name: str, suffix: str = "",
           keep: list[str] | None = None) -> str:
    part = "partition by location" if key else ""
    cols = []
    for m in measures:
        lo, hi = f"min({m}) over ({part})", f"max({m}) over ({part})"
        cols.append(f"case when {hi} = {lo} then (case when {m} is not null then 0.0 end) "
                    f"else ({m} - {lo}) / ({hi} - {lo}) end as {m}{suffix}")
    base = ", ".join(keep) if keep is not None else "*"
    if keep is None and not suffix:
        base = "* exclude (" + ", ".join(measures) + ")"
    return f"{name} as (select {base}, {', '.join(cols)} from {src})"
