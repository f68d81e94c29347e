"""Read-only SQL: taking a statement out of a model's reply, checking its parsed plan, and running it under guards."""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..config import Settings
from ..functions.vocabulary import FORBIDDEN_SQL

#: Nodes of a parsed statement that only read.
READING = {
    "Project", "Filter", "Aggregate", "Join", "UnresolvedRelation", "UnresolvedWith", "SubqueryAlias", "Sort", "GlobalLimit", "LocalLimit",
    "Offset", "Distinct", "Union", "Intersect", "Except", "UnresolvedHaving", "UnresolvedSubqueryColumnAliases", "OneRowRelation", "Generate",
    "LateralJoin", "AsOfJoin", "WithWindowDefinition", "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "UnresolvedInlineTable",
    "LocalRelation", "Pivot", "Unpivot", "UnresolvedHint", "Sample", "UnresolvedOrderedSubquery", "Window", "Tail", "UnionLoop", "UnionLoopRef", "Range",
}
#: Functions that reach outside the query.
DENIED_FUNCTIONS = {"reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "current_user", "session_user", "user"}
FILE_FORMATS = {"parquet", "orc", "csv", "json", "text", "xml", "avro", "binaryfile", "delta", "jdbc"}
_SUBQUERIES = {"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"}


class UnsafeSQL(ValueError):
    """The statement is not a single read-only query."""


class UnparsedSQL(UnsafeSQL):
    """The text is no statement at all; another part of the reply may be."""


@dataclass
class Execution:
    """The outcome of a statement: rows, or an error; never an exception."""

    sql: str
    columns: list[str] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)
    error: str | None = None
    seconds: float = 0.0

    @property
    def ok(self) -> bool:
        return self.error is None


def candidates(reply: str) -> Iterator[str]:
    """Statements that a reply may hold: without code fences, from each SELECT or WITH on, to the end of the statement."""
    text = re.sub(r"```[a-zA-Z]*", "", reply).strip()
    for m in re.finditer(r"\b(?:select|with)\b", text, re.IGNORECASE):
        yield _first_statement(text[m.start() :])


def _first_statement(text: str) -> str:
    """Up to the first semicolon outside of quotes and comments."""
    quote, i = "", 0
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\" and quote != "`":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "'\"`":
            quote = c
        elif text.startswith("--", i):
            i = (text.find("\n", i) + 1 or len(text) + 1) - 1
        elif text.startswith("/*", i):
            i = (text.find("*/", i) + 2 if text.find("*/", i) >= 0 else len(text)) - 1
        elif c == ";":
            return text[:i].strip()
        i += 1
    return text.strip()


def _items(seq) -> Iterator:
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def _check_expression(e) -> None:
    kind = e.getClass().getSimpleName()
    if kind == "UnresolvedFunction":
        name = ".".join(_items(e.nameParts())).lower()
        if name.rpartition(".")[2] in DENIED_FUNCTIONS:
            raise UnsafeSQL(f"function {name} is not allowed")
    if kind in _SUBQUERIES:
        _check_plan(e.plan())
    for c in _items(e.children()):
        _check_expression(c)


def _check_plan(plan) -> None:
    kind = plan.getClass().getSimpleName()
    if kind not in READING:
        raise UnsafeSQL(f"{kind} is not allowed")
    if kind == "UnresolvedRelation":
        parts = [str(x) for x in _items(plan.multipartIdentifier())]
        if len(parts) > 1 and parts[0].lower() in FILE_FORMATS:
            raise UnsafeSQL("files can't be read by path")
    if kind == "UnresolvedTableValuedFunction":
        name = ".".join(str(x) for x in _items(plan.name())).lower()
        if name not in ("range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple", "chunk"):
            raise UnsafeSQL(f"table function {name} is not allowed")
    for e in _items(plan.expressions()):
        _check_expression(e)
    for c in _items(plan.children()):
        _check_plan(c)
    if kind == "UnresolvedWith":
        for pair in _items(plan.cteRelations()):
            _check_plan(pair._2())


def check(spark: SparkSession, sql: str) -> None:
    """Raises UnsafeSQL unless the statement parses as one read-only query that starts with SELECT or WITH."""
    if not re.match(r"\s*(?:select|with)\b", sql, re.IGNORECASE):
        raise UnsafeSQL("not a SELECT")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise UnparsedSQL(f"it can't be parsed: {str(e).splitlines()[0][:200]}") from None
    _check_plan(plan)


def safe_select(spark: SparkSession, reply: str) -> str:
    """The first statement of a reply that can be parsed, if it only reads.

    The row limit is put around it when it runs, so a LIMIT inside stays as it is.
    """
    last: UnsafeSQL | None = None
    for sql in candidates(reply):
        try:
            check(spark, sql)
            return sql
        except UnparsedSQL as e:
            last = last or e
    raise last or UnsafeSQL("no SELECT in the reply")


def safe_select_strict(reply: str, max_rows: int) -> str:
    """Word-list mode: rejects any forbidden word, even in a literal; clamps or appends LIMIT."""
    sql = next(candidates(reply), "")
    if not sql:
        raise UnsafeSQL("no SELECT in the reply")
    found = [w for w in FORBIDDEN_SQL if re.search(rf"\b{w}\b", sql, re.IGNORECASE)]
    if found:
        raise UnsafeSQL(f"forbidden: {', '.join(found)}")
    limit = re.search(r"\blimit\s+(\d+)\s*$", sql, re.IGNORECASE)
    if not limit:
        return f"{sql} LIMIT {max_rows}"
    return sql if int(limit[1]) <= max_rows else f"{sql[: limit.start()]}LIMIT {max_rows}"


def estimated_bytes(df: DataFrame) -> int:
    """Bytes that the optimized plan's scans read, by the statistics of the sources."""

    def of(plan) -> int:
        kids = list(_items(plan.children()))
        return sum(of(k) for k in kids) if kids else int(str(plan.stats().sizeInBytes()))

    return of(df._jdf.queryExecution().optimizedPlan())


def run(spark: SparkSession, reply: str, settings: Settings = Settings()) -> Execution:  # noqa: B008
    """Runs the query of a reply under the guards. All failures become Execution.error."""
    began = time.monotonic()
    try:
        sql = safe_select(spark, reply)
    except UnsafeSQL as e:
        return Execution(reply, error=f"unsafe SQL rejected: {e}")
    tag, tripped = f"guard-{uuid.uuid4().hex}", threading.Event()
    sc = spark.sparkContext

    def stop() -> None:
        tripped.set()
        while not done.wait(0.05):  # jobs that start after a first cancellation too
            sc.cancelJobsWithTag(tag)

    done = threading.Event()
    timer = threading.Timer(settings.sql_timeout_s, stop)
    timer.daemon = True
    sc.addJobTag(tag)
    try:
        timer.start()
        df = spark.sql(sql)
        if settings.sql_scan_budget_bytes and (n := estimated_bytes(df)) > settings.sql_scan_budget_bytes:
            return Execution(sql, error=f"exceeded the scan budget: {n} bytes of {settings.sql_scan_budget_bytes}")
        if tripped.is_set():  # planning took the time
            return Execution(sql, error=f"exceeded {settings.sql_timeout_s:g} s", seconds=time.monotonic() - began)
        rows = [tuple(r) for r in df.limit(settings.sql_max_rows).collect()]
        return Execution(sql, df.columns, rows, seconds=time.monotonic() - began)
    except Exception as e:
        why = f"exceeded {settings.sql_timeout_s:g} s" if tripped.is_set() else f"SQL execution failed: {str(e).splitlines()[0][:300]}"
        return Execution(sql, error=why, seconds=time.monotonic() - began)
    finally:
        done.set()
        timer.cancel()
        sc.removeJobTag(tag)


def render(columns: list[str], rows: list[tuple], limit: int | None = None) -> str:
    """A text table; null is empty."""
    if not columns:
        return "(no columns)"
    if not rows:
        return "(no rows)"
    shown = rows[:limit] if limit else rows
    return "\n".join([" | ".join(columns), "---", *(" | ".join("" if x is None else str(x) for x in r) for r in shown)])
