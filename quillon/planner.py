"""Steps around Catalyst: read-only check, defensive limit, cost budget, pushdown decision, plan tree.

These read the plans that Spark has made (classic sessions; not over Spark Connect).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quillon.errors import Code, make
from quillon.functions.compat import tokens

_READ = {"SELECT", "WITH", "VALUES", "TABLE", "FROM", "EXPLAIN", "SHOW", "DESCRIBE", "DESC", "("}


def check_read_only(sql: str) -> None:
    """Only queries pass; commands, and the join forms that Spark would misread, do not."""
    ts = [t for t in tokens(sql) if not t.isspace() and not t.startswith(("--", "/*"))]
    if not ts:
        raise make(Code.SYNTAX_ERROR, "empty statement")
    up = [t.upper() for t in ts]
    if up[0] not in _READ:
        raise make(Code.AUTHORIZATION_DENIED, f"only queries are allowed, not {up[0]}")
    if ";" in ts[:-1]:
        raise make(Code.SYNTAX_ERROR, "one statement at a time")
    depth = 0
    for i, t in enumerate(up):
        depth += (t == "(") - (t == ")")
        if t in ("INSERT", "CREATE", "DROP", "DELETE", "MERGE", "TRUNCATE", "ALTER") and depth == 0 and i and up[0] == "WITH" and up[i - 1] == ")":
            raise make(Code.AUTHORIZATION_DENIED, f"only queries are allowed, not {t}")
        if t == "ASOF" and i + 1 < len(up) and up[i + 1] == "JOIN":
            raise make(Code.NOT_IMPLEMENTED, "ASOF JOIN is not supported")


def node_names(plan) -> list[str]:
    """Names of a JVM plan's nodes, root first."""
    out, todo = [], [plan]
    while todo:
        p = todo.pop()
        out.append(p.nodeName().split(" ")[0])
        kids = p.children()
        todo += [kids.apply(i) for i in reversed(range(kids.size()))]
    return out


#: Roots that are never limited; any Aggregate or Distinct in the plan also rules the limit out.
_NO_LIMIT = {"GlobalLimit", "LocalLimit", "Limit", "Offset", "Aggregate", "Window", "ExplainCommand", "ShowTables", "ShowTablesCommand", "DescribeRelation", "DescribeTableCommand", "CommandResult"}


def defensive_limit(df: DataFrame, n: int | None) -> tuple[DataFrame, list[str]]:
    """``df`` with a limit at its root if it has none and could return any number of rows."""
    if not n:
        return df, []
    names = node_names(df._jdf.queryExecution().analyzed())
    root = next((x for x in names if x not in ("SubqueryAlias", "View", "ResolvedHint")), names[0])
    at = names.index(root)
    # ORDER BY .. LIMIT is a limit at the root already; a Project over a Window is limited.
    if root in _NO_LIMIT or {"Aggregate", "Distinct", "Deduplicate"} & set(names) or root == "Project" and names[at + 1 : at + 2] == ["GlobalLimit"]:
        return df, []
    return df.limit(n), [f"Result limited to {n} rows; add a LIMIT to choose another number"]


@dataclass
class Cost:
    rows: int | None
    bytes: int | None


def estimate(df: DataFrame, table_rows: dict[str, int] | None = None) -> Cost:
    """The largest row and byte estimates over the optimised plan's nodes; None where nothing is known.

    Spark knows no row count of plain files, so counts from footers at registration may be given by
    the file path that a relation reads.
    """
    rows, size, todo = [], [], [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        p = todo.pop()
        s = p.stats()
        if s.rowCount().isDefined():
            rows.append(int(str(s.rowCount().get())))
        kids = p.children()
        if not kids.size():
            b = int(str(s.sizeInBytes()))
            if b < (1 << 62):
                size.append(b)
        todo += [kids.apply(i) for i in range(kids.size())]
    if table_rows:
        files = set(df.inputFiles()) if len(table_rows) else set()
        rows += [n for path, n in table_rows.items() if any(path.removeprefix("file://") in f for f in files)]
    return Cost(max(rows, default=None), max(size, default=None))


def check_budget(df: DataFrame, max_rows: int | None, max_bytes: int | None, table_rows: dict[str, int] | None = None) -> Cost:
    """Rejects a plan whose largest estimate is above the budget; unknown estimates pass."""
    cost = estimate(df, table_rows)
    for what, have, most in (("rows", cost.rows, max_rows), ("bytes", cost.bytes, max_bytes)):
        if most is not None and have is not None and have > most:
            raise make(Code.BUDGET_EXCEEDED, f"estimated {what} {have} exceed the budget of {most}", "add filters or raise the limit", **{f"estimated_{what}": have, "limit": most})
    return cost


def is_deterministic(df: DataFrame) -> bool:
    """False for plans with rand(), uuid(), current_timestamp() and the like."""
    text = df._jdf.queryExecution().analyzed().toString()
    return df._jdf.queryExecution().analyzed().deterministic() and not re.search(r"\b(rand|randn|uuid|shuffle|now|current_(timestamp|date|time)|localtimestamp|monotonically_increasing_id)\(", text)


def plan_tree(df: DataFrame) -> str:
    """The physical plan as an ASCII tree: joins with keys, scans with what was pushed into them."""
    plan = df._jdf.queryExecution().executedPlan()
    lines: list[str] = []

    def shown(p) -> str:
        name, text = p.nodeName(), p.simpleString(10_000)
        if "Scan" in name or "BatchScan" in name:
            pushed = re.search(r"PushedFilters: \[([^\]]*)\]", text)
            columns = re.search(r"ReadSchema: struct<(.*?)>(?:,|$)", text)
            mark = " [PUSHED]" if pushed and pushed[1] or "PUSHED" in text else ""
            return name + mark + (f" filters=[{pushed[1]}]" if pushed and pushed[1] else "") + (f" columns=[{columns[1]}]" if columns else "")
        if name == "Filter":
            return "Filter [NOT PUSHED] " + text.removeprefix("Filter ").strip() if p.children().size() and "Scan" not in p.children().apply(0).nodeName() else "Filter " + text.removeprefix("Filter ").strip()
        return re.sub(r"#\d+L?", "", text)[:200] if re.search("Join|Aggregate|Sort|Exchange|Limit|Window|Project", name) else name

    def walk(p, head: str, last: bool, top: bool) -> None:
        while p.nodeName().startswith(("WholeStageCodegen", "InputAdapter", "AdaptiveSparkPlan", "ResultQueryStage", "ShuffleQueryStage", "BroadcastQueryStage", "ColumnarToRow")):
            p = p.executedPlan() if p.nodeName().startswith("AdaptiveSparkPlan") else p.plan() if "QueryStage" in p.nodeName() else p.children().apply(0)
        lines.append(re.sub(r"#\d+L?", "", ("" if top else head + ("└─ " if last else "├─ ")) + shown(p)))
        kids = p.children()
        for i in range(kids.size()):
            walk(kids.apply(i), "" if top else head + ("   " if last else "│  "), i == kids.size() - 1, False)

    walk(plan, "", True, True)
    return "\n".join(lines)


def query_report(df: DataFrame, sample: int = 10) -> str:
    """The plan, a run of it, its first rows and totals."""
    import time

    began = time.time()
    table = df.toArrow()
    took = time.time() - began
    head = table.slice(0, sample).to_pandas().to_string(index=False) if table.num_rows else "(no rows)"
    return f"QUERY REPORT\n============\nPlan:\n{plan_tree(df)}\n\nFirst {min(sample, table.num_rows)} rows:\n{head}\n\nTotal rows: {table.num_rows}\nTotal bytes: {table.nbytes}\nSeconds: {took:.3f}\n"


def referenced(spark: SparkSession, sql: str) -> list[str]:
    """Names of the tables that a statement reads, CTEs left out, from the parsed plan."""
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    text, out = parsed.toString(), []
    ctes = set(re.findall(r"CTE \[([^\]]*)\]", text))
    local = {n.strip() for c in ctes for n in c.split(",")}
    for m in re.finditer(r"UnresolvedRelation \[([^\]]+)\]", text):
        name = ".".join(p.strip() for p in m[1].split(","))
        if name not in local and name not in out:
            out.append(name)
    return out
