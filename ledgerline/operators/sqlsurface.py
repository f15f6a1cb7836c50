"""Read-only SQL over named tables: file_1 to file_n are views of a session of their own; Spark plans the query.

Spark's parser turns a query into a plan before anything is looked up or run, and that plan is judged, not the text: only
nodes that read, only functions that come with Spark (less those that call Java methods) or with the dialect, only tables that were opened
or that the query itself names. How a name is quoted or where comments stand makes no difference then.
Previews, limits and pages are plan operators, so a preview never runs a whole query to show its first rows.
"""

from __future__ import annotations

import difflib
import json
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import ParseException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dialect
from .profile import finite

MOST_TABLES, PREVIEW_ROWS = 10, 100
#: Numbers over this size count as broken in a result that goes out as JSON.
LARGEST = 1e15
# The classes of queries in the order they are tried; of each group of words one has to occur, in any case.
CLASSES = {
    "reconciliation": [("full outer join", "coalesce", "tolerance_mismatch", "matched")],
    "delta_analysis": [("newly_added", "deleted", "amended", "unchanged", "change_type")],
    "transformation": [("regexp_extract", "trim", "upper", "lower", "cast", "regexp_replace")],
    "join_operation": [("full outer join", "left join", "right join")],
    "aggregation": [("count", "sum", "avg", "min", "max")],
    "filtering": [("where",), ("not", "!=")],
    "sorting": [("order by",)],
    "grouping": [("group by",)],
    "complex_query": [("with",)],
}
OTHER_CLASS = "data_analysis"
# Names of the parser's nodes that only read; expressions may be any but those of _REFUSED.
_PLANS = (
    "Aggregate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LateralSubquery LocalLimit LocalRelation Offset OneRowRelation PipeOperator PipeExpression Pivot Project Range Sample Sort "
    "SubqueryAlias Union UnionLoop Unpivot UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction UnresolvedTVFAliases UnresolvedWith Window WithWindowDefinition"
).split()
_REFUSED = ("ExpressionWithUnresolvedIdentifier", "PlanWithUnresolvedIdentifier", "CallMethodViaReflection", "TryReflect", "PythonUDF", "PythonUDTF")
#: Functions of Spark that run Java methods, or read what is no table.
_NOT_ALLOWED = {"reflect", "try_reflect", "java_method", "python_worker_logs"}
# What each occurrence adds to a query's complexity.
_COSTS = {"join": 2, "subquery": 3, "group by": 1, "order by": 1, "having": 2, "union": 2}


@dataclass
class Tables:
    """The session and the views that queries see. Closing it drops them."""

    spark: SparkSession
    views: list[str]
    functions: set[str] = field(default_factory=set)

    def close(self) -> None:
        for name in self.views:
            self.spark.catalog.dropTempView(name)

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def open_tables(tables: Sequence[DataFrame] | Mapping[str, DataFrame]) -> Tables:
    """Views named file_1, file_2, ... in order (or by the mapping's names), visible to this session only."""
    named = tables if isinstance(tables, Mapping) else {f"file_{i}": t for i, t in enumerate(tables, 1)}
    if not 1 <= len(named) <= MOST_TABLES:
        raise ValueError(f"1 to {MOST_TABLES} tables, not {len(named)}")
    session = next(iter(named.values())).sparkSession.newSession()
    for key, value in (("spark.sql.ansi.doubleQuotedIdentifiers", "true"), ("spark.sql.session.timeZone", "UTC"), ("spark.sql.runSQLOnFiles", "false")):
        session.conf.set(key, value)
    own = dialect.install(session)
    plans = session.sparkContext._jvm.org.apache.spark.sql.classic.Dataset
    for name, t in named.items():  # the table's plan in the new session, so that no other session sees the view
        DataFrame(plans.ofRows(session._jsparkSession, t._jdf.queryExecution().logical()), session).createOrReplaceTempView(name)
    return Tables(session, list(named), known_functions(session) | {f.lower() for f in own})


# --------------------------------------------------------------------- parse


@dataclass
class Parsed:
    """What a query's plan names, before anything is looked up."""

    nodes: list[str]  # of plans, as the parser calls them
    tables: list[str]
    functions: list[str]
    columns: list[str]
    with_names: list[str]  # of common table expressions
    aliases: list[str]  # of tables and subqueries


def _dicts(tree: Any) -> Iterator[dict]:
    stack = [tree]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            yield x
            stack += list(x.values())[::-1]
        elif isinstance(x, list):
            stack += x[::-1]


def parsed(spark: SparkSession, query: str) -> Parsed:
    """The query by Spark's parser with this session's settings. ParseException if it is none; nothing is looked up or run."""
    sessions, own = spark.sparkContext._jvm.org.apache.spark.sql.SparkSession, spark._jsparkSession
    before = sessions.getActiveSession()
    sessions.setActiveSession(own)
    try:
        tree = json.loads(own.sessionState().sqlParser().parsePlan(query.strip().rstrip("; \t\r\n")).toJSON())
    finally:
        sessions.setActiveSession(before.get()) if before.isDefined() else sessions.clearActiveSession()
    out = Parsed([], [], [], [], [], [])
    parts = lambda x: x.strip("[]").split(", ")
    for x in _dicts(tree):
        if "class" not in x:
            continue
        package, _, kind = x["class"].rpartition(".")
        if kind in _REFUSED or not package.endswith((".expressions", ".expressions.aggregate", ".expressions.xml", ".expressions.variant", ".analysis")) or kind in _PLANS:
            out.nodes.append(kind)
        if kind == "UnresolvedRelation":
            out.tables.append(".".join(parts(x["multipartIdentifier"])))
        elif kind in ("UnresolvedFunction", "UnresolvedTableValuedFunction"):
            out.functions.append(".".join(parts(x["nameParts"] if "nameParts" in x else x["name"])).lower())
        elif kind == "UnresolvedGenerator":
            out.functions.append(".".join(x["name"][k] for k in ("catalog", "database", "funcName") if x["name"].get(k)).lower())
        elif kind == "UnresolvedAttribute":
            out.columns.append(".".join(parts(x["nameParts"])))
        elif kind == "UnresolvedWith":
            out.with_names += [r["_1"] for r in x["cteRelations"]]
        elif kind == "SubqueryAlias":
            out.aliases.append(x["identifier"]["name"])
    return out


def known_functions(spark: SparkSession) -> set[str]:
    """The functions that come with Spark, less those that may not be called."""
    return {r[0].lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect()} - _NOT_ALLOWED


def refused(query: Parsed, functions: set[str], tables: Sequence[str] | None = None) -> str | None:
    """Why a query may not run, None if it may. tables: those it may read; None doesn't ask."""
    if bad := next((n for n in query.nodes if n not in _PLANS), None):
        return f"only queries that read are allowed, not {bad}"
    if bad := next((f for f in query.functions if f not in functions), None):
        return f"function {bad} is not allowed or not known"
    if tables is not None:
        known = {t.lower() for t in [*tables, *query.with_names]}
        if bad := next((t for t in query.tables if t.lower() not in known), None):
            return f"no table {bad}"
    return None


class UnknownTable(ValueError):
    """A query names a table that was not opened."""


def read_only(spark: SparkSession, query: str, also: set[str] | None = None) -> bool:
    """Whether the text is one query that only reads; names that don't resolve don't matter. Nothing runs. also: further functions that may be called."""
    try:
        return refused(parsed(spark, query), known_functions(spark) | (also or set(dialect.FUNCTIONS) | {"similarity"})) is None
    except ParseException:
        return False


def run(tables: Tables, query: str, limit: int | None = None, parameters: Mapping[str, Any] | None = None) -> DataFrame:
    """The query's result, lazily; a limit applies unless the query's own is less. parameters: for :name markers."""
    try:
        judged = parsed(tables.spark, query)
    except ParseException as e:
        raise ValueError(f"no query that only reads: {str(e)[:300]}") from e
    if why := refused(judged, tables.functions, tables.views):
        raise UnknownTable(why) if why.startswith("no table ") else ValueError(why)
    out = tables.spark.sql(query.strip().rstrip("; \t\r\n"), args=dict(parameters) if parameters else None)
    return out.limit(limit) if limit is not None else out


def schema_of(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema]


def preview(df: DataFrame, rows: int = PREVIEW_ROWS) -> tuple[DataFrame, int]:
    """The first rows, fit for JSON, and the number of all rows."""
    return finite(df.limit(rows), LARGEST), df.count()


def query_class(query: str) -> str:
    low = re.sub(r"\s+", " ", query.lower())
    return next((name for name, groups in CLASSES.items() if all(any(w in low for w in words) for words in groups)), OTHER_CLASS)


def complexity(query: str) -> int:
    low = re.sub(r"\s+", " ", query.lower())
    return sum(n * len(re.findall(rf"\b{w}\b", low)) for w, n in _COSTS.items())


def notes(query: str, seconds: float | None = None, rows: int | None = None) -> list[str]:
    """Suggestions for a query by its text and its run."""
    low, out = query.lower(), []
    if re.search(r"select\s+\*", low):
        out.append("Name the columns that are needed instead of *")
    if " join " in f" {low} " and " on " not in f" {low} " and " using" not in low:
        out.append("Give the join a condition")
    if "order by" in low and "limit" not in low:
        out.append("Add a limit to an ordered result")
    if "like '%" in low:
        out.append("A leading % reads the whole column")
    if seconds is not None and seconds > 5:
        out.append(f"It took {seconds:.1f} s; filter earlier or aggregate first")
    if rows is not None and rows > 10_000:
        out.append(f"{rows} rows; page through them or aggregate")
    return out


def result_risks(rows: int, input_rows: int) -> list[str]:
    """What a result's size suggests."""
    out = []
    if rows == 0:
        out.append("empty result: check filters and join keys")
    if input_rows and rows > 2 * input_rows:
        out.append("more than twice the input's rows: the join may repeat rows")
    if rows > 50_000:
        out.append("over 50000 rows")
    return out


def estimate(df: DataFrame) -> dict[str, Any]:
    """What the optimizer expects of a query: bytes and, if known, rows; nothing runs."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    rows = stats.rowCount()
    return {"bytes": int(str(stats.sizeInBytes())), "rows": int(str(rows.get())) if rows.isDefined() else None}


def explain_error(error: Exception, tables: Tables, query: str | None = None) -> dict[str, Any]:
    """kind (table, cte_column, column, syntax or other), the name that isn't known and the names like it.

    cte_column: a column is missing that the query qualifies by one of its own names (a common table expression or an alias).
    """
    if isinstance(error, UnknownTable):
        name = str(error).removeprefix("no table ")
        return {"kind": "table", "name": name, "suggestions": difflib.get_close_matches(name, tables.views, cutoff=0.3) or tables.views}
    condition = error.getCondition() if isinstance(error, PySparkException) else None
    text = str(error)
    quoted = re.findall(r"`([^`]+)`", text)
    if condition and condition.startswith("TABLE_OR_VIEW_NOT_FOUND"):
        return {"kind": "table", "name": quoted[-1] if quoted else None, "suggestions": difflib.get_close_matches((quoted or [""])[-1], tables.views, cutoff=0.3) or tables.views}
    if condition and condition.startswith("UNRESOLVED_COLUMN"):
        known = sorted({c for v in tables.views for c in tables.spark.table(v).columns})
        name = quoted[0] if quoted else ""
        if query is not None:
            own = parsed(tables.spark, query)
            qualifier = re.search(r"`([^`]+)`\.`([^`]+)`", text)
            if qualifier and qualifier[1].lower() in {x.lower() for x in [*own.with_names, *own.aliases]}:
                offered = re.findall(r"`([^`]+)`", text.partition("Did you mean")[2])
                return {"kind": "cte_column", "name": f"{qualifier[1]}.{qualifier[2]}", "suggestions": difflib.get_close_matches(qualifier[2], offered or known, cutoff=0.3)}
        return {"kind": "column", "name": name, "suggestions": difflib.get_close_matches(name, known, cutoff=0.4)}
    if "no query that only reads" in text or (condition or "").startswith("PARSE"):
        return {"kind": "syntax", "name": None, "suggestions": []}
    return {"kind": "other", "name": None, "suggestions": []}


def column_references(query: str, columns: Sequence[str]) -> dict[str, Any]:
    """Quoted names in a query: which exist, which don't, and names like the missing ones."""
    named = list(dict.fromkeys(re.findall(r'"([^"]+)"', query)))
    missing = [n for n in named if n not in columns]
    return {"found": [n for n in named if n in columns], "missing": missing, "suggestions": {m: difflib.get_close_matches(m, columns, cutoff=0.6) for m in missing}}


def column_hints(prompt: str, columns: Sequence[str]) -> list[str]:
    """Columns that a sentence mentions, in any spelling with spaces, dashes or underscores."""
    plain = lambda s: re.sub(r"[\s_-]+", " ", s.lower())
    text = plain(prompt)
    words = text.split()
    return [c for c in columns if plain(c) in text or any(difflib.SequenceMatcher(None, plain(c), w).ratio() >= 0.85 for w in words)]


def markdown_rows(text: str) -> list[dict[str, str]]:
    """The rows of the first Markdown table in a text."""
    lines = [[c.strip() for c in x.strip().strip("|").split("|")] for x in text.splitlines() if x.strip().startswith("|")]
    if len(lines) < 2:
        return []
    return [dict(zip(lines[0], x)) for x in lines[1:] if not all(re.fullmatch(r":?-+:?", c) for c in x)]


def sanitized(df: DataFrame) -> DataFrame:
    """NaN, infinite and huge numbers become null."""
    return finite(df, LARGEST)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"))
