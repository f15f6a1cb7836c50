"""Rule-driven transformation: rules of output columns, row expansion, mappings, validation and output formats.

A rule turns each source row into one output row, in one projection; a later column of a rule may use earlier ones.
Several sources are put one below the other by column name. Everything is a native expression; a user function is a
registered Column function, never code in the configuration.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canon import date_of, is_number, text_number, text_of, type_of
from ..functions.predicates import every, value_kind
from ..functions.expressions import condition, dynamic, formula, template
from ..session import free_name, q, require
from .percentiles import percentiles

# ------------------------------------------------------------------ rule engine


@dataclass(frozen=True)
class Case:
    column: str
    operator: str
    value: Any
    output: Any


@dataclass(frozen=True)
class Output:
    """An output column: direct (a source column), static (a template) or dynamic (the first case that holds)."""

    name: str
    kind: str = "direct"
    source: str | None = None
    value: Any = None
    cases: Sequence[Case] = ()
    default: Any = ""


@dataclass(frozen=True)
class Rule:
    id: str
    outputs: Sequence[Output]
    name: str = ""
    enabled: bool = True
    priority: int = 0
    condition: str = ""


def _output(df: DataFrame, o: Output) -> Column:
    if o.kind == "direct":
        return F.col(q(o.source)) if o.source in df.columns else F.lit("")
    if o.kind == "static":
        return template(df, "" if o.value is None else o.value)
    if o.kind != "dynamic":
        raise ValueError(f"unknown mapping {o.kind!r}; known: direct, static, dynamic")
    results = [(dynamic(df, c.column, c.operator, c.value), template(df, c.output)) for c in o.cases if c.column in df.columns]
    out = template(df, o.default).cast("string")
    for met, value in reversed(results):
        out = F.when(met, value.cast("string")).otherwise(out)
    return out


def _seeing(o: Output, earlier: Mapping[str, str]) -> Output:
    """The output with the names of earlier ones put in place of its own references to them."""

    def put(value: Any) -> Any:
        for name, own in earlier.items():
            if isinstance(value, str):
                value = value.replace("{" + name + "}", "{" + own + "}")
        return value

    cases = [Case(earlier.get(c.column, c.column), c.operator, c.value, put(c.output)) for c in o.cases]
    return Output(o.name, o.kind, earlier.get(o.source, o.source), put(o.value), cases, put(o.default))


def apply_rule(df: DataFrame, rule: Rule, honor_condition: bool = False) -> DataFrame:
    """The rule's output columns for every row (those that meet its condition, if honor_condition)."""
    if honor_condition:
        df = df.filter(condition(df, rule.condition))
    earlier: dict[str, str] = {}
    made: list[str] = []
    for i, o in enumerate(rule.outputs):
        made.append(free_name(df, f"out{i}"))
        df = df.withColumn(made[i], _output(df, _seeing(o, earlier)))
        earlier[o.name] = made[i]
    return df.select(*[F.col(m).alias(o.name) for m, o in zip(made, rule.outputs)])


def union_of(sources: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def transform(sources: DataFrame | Sequence[DataFrame], rules: Sequence[Rule], merge: bool = True, honor_condition: bool = False) -> dict[str, DataFrame]:
    """{"merged": all rules' rows} or one entry for each enabled rule's id. With honor_condition, rules go by priority."""
    df = sources if isinstance(sources, DataFrame) else union_of(list(sources))
    live = [r for r in rules if r.enabled]
    if honor_condition:
        live = sorted(live, key=lambda r: r.priority)
    if not live:
        raise ValueError("no rule is enabled")
    each = {r.id: apply_rule(df, r, honor_condition) for r in live}
    return {"merged": union_of(list(each.values()))} if merge else each


# -------------------------------------------------------------------- expansion


@dataclass(frozen=True)
class Expansion:
    """How a row becomes several.

    duplicate: `count` copies. fixed: one for each of `sets`, which set columns. from_list: one for each of `values`, in
    `column`. conditional: those of `sets` if `condition` holds, else of `other`. from_table: one for each row of the
    other table with the same key.
    """

    kind: str
    count: int = 1
    column: str = ""
    values: Sequence[Any] = ()
    sets: Sequence[Mapping[str, Any]] = ()
    other: Sequence[Mapping[str, Any]] = ()
    condition: str = ""


def _set_structs(names: Sequence[str], sets: Sequence[Mapping[str, Any]]) -> Column:
    struct = lambda i, s: F.struct(F.lit(i).alias("_expansion_index"), *[F.lit(None if s.get(n) is None else str(s[n])).cast("string").alias(n) for n in names], *[F.lit(n in s).alias(f"_has_{n}") for n in names])
    return F.array(*[struct(i, s) for i, s in enumerate(sets)])


def expand(df: DataFrame, e: Expansion, met: Column | None = None) -> DataFrame:
    """The expanded rows with _expansion_index; values set are text. met: rows to expand, others stay single."""
    keep = (lambda c: c) if met is None else (lambda c: F.when(met, c).otherwise(F.slice(c, 1, 1)))
    if e.kind == "duplicate":
        n = F.lit(max(int(e.count), 0))
        if e.count < 1:
            return df.withColumn("_expansion_index", F.lit(0)).limit(0)
        return df.withColumn("_expansion_index", F.explode(keep(F.sequence(F.lit(0), n - 1))))
    if e.kind == "from_list":
        pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(e.values)])
        one = free_name(df, "one")
        out = df.withColumn(one, F.explode(keep(pairs)))
        return out.withColumn(e.column, F.col(one)["v"]).withColumn("_expansion_index", F.col(one)["i"]).drop(one)
    if e.kind in ("fixed", "conditional"):
        names = list(dict.fromkeys(k for s in [*e.sets, *e.other] for k in s))
        structs = _set_structs(names, e.sets)
        if e.kind == "conditional":
            structs = F.when(condition(df, e.condition), structs).otherwise(_set_structs(names, e.other))
        one = free_name(df, "one")
        out = df.withColumn(one, F.explode(keep(structs)))
        for n in names:
            old = text_of(df, n) if n in df.columns else F.lit(None).cast("string")
            out = out.withColumn(n, F.when(F.col(one)[f"_has_{n}"], F.col(one)[n]).otherwise(old))
        return out.withColumn("_expansion_index", F.col(one)["_expansion_index"]).drop(one)
    raise ValueError(f"unknown expansion {e.kind!r}; known: duplicate, fixed, from_list, conditional (and expand_from_table)")


def expand_from_table(df: DataFrame, other: DataFrame, keys: Sequence[tuple[str, str]], take: Sequence[str], other_pos: str) -> DataFrame:
    """One row for each row of `other` with equal keys, numbered by its position; a row without any stays, with nulls."""
    require(other, [k for _, k in keys] + list(take), "the expansion table")
    own, row = free_name(df, "id"), free_name(df, "row")
    names = [free_name(df, f"key{i}") for i in range(len(keys))]
    right = other.select(*[F.col(q(k)).alias(n) for n, (_, k) in zip(names, keys)], F.struct(F.col(q(other_pos)).alias("_pos"), *[F.col(q(c)).alias(f"v{i}") for i, c in enumerate(take)]).alias(row))
    on = reduce(lambda a, b: a & b, [F.col(q(k)) == F.col(n) for n, (k, _) in zip(names, keys)])
    rows = df.withColumn(own, F.monotonically_increasing_id()).join(right, on, "left")
    index = F.row_number().over(Window.partitionBy(own).orderBy(F.col(row)["_pos"])) - 1
    return rows.withColumn("_expansion_index", index).select(*[q(c) for c in df.columns if c not in take], *[F.col(row)[f"v{i}"].alias(c) for i, c in enumerate(take)], "_expansion_index")


@dataclass(frozen=True)
class ChosenRule:
    condition: str
    expansion: Expansion
    priority: int = 0
    enabled: bool = True


def expand_by_rule(df: DataFrame, rules: Sequence[ChosenRule]) -> DataFrame:
    """Each row is expanded by the first rule, by priority, whose condition holds; a row that meets none stays as it is."""
    out, chosen = [], F.lit(-1)
    ordered = sorted((r for r in rules if r.enabled), key=lambda r: r.priority)
    for i, r in reversed(list(enumerate(ordered))):
        chosen = F.when(condition(df, r.condition), F.lit(i)).otherwise(chosen)
    rule = free_name(df, "rule")
    left = df.withColumn(rule, chosen)
    for i, r in enumerate(ordered):
        out.append(expand(left.filter(F.col(rule) == i).drop(rule), r.expansion))
    out.append(left.filter(F.col(rule) == -1).drop(rule).withColumn("_expansion_index", F.lit(0)))
    return union_of(out)


# ---------------------------------------------------------------------- mappings


def lookup(df: DataFrame, table: DataFrame, source: str, key: str, take: str, into: str, default: Any = None, table_pos: str | None = None) -> DataFrame:
    """Add `into`: `take` of the table's first row (by position) whose key equals the source value; else the default.

    A matched null stays null. The table has one row for a key before the join; Spark broadcasts it if it is small. Values
    of different kinds (a number and a text) are never equal.
    """
    require(df, [source], "the table")
    require(table, [key, take], "the lookup table")
    if value_kind(df, source) != value_kind(table, key):
        return df.withColumn(into, F.lit(default).cast(table.schema[take].dataType) if default is None else F.lit(default))
    met, hit = free_name([*df.columns, into], "met"), free_name([*df.columns, into], "hit")
    order = F.col(q(table_pos)) if table_pos else F.lit(0)
    first = table.filter(F.col(q(key)).isNotNull()).groupBy(F.col(q(key)).alias(met)).agg(F.min_by(F.struct(F.col(q(take)).alias("v")), order).alias(hit))
    out = df.join(first, F.col(q(source)) == F.col(met), "left")
    value = F.when(F.col(hit).isNotNull(), F.col(hit)["v"]).otherwise(F.lit(default))
    return out.withColumn(into, value).drop(met, hit)


def sequence(df: DataFrame, order: str, into: str, start: int = 1, increment: int = 1, prefix: str = "", suffix: str = "", padding: int = 0, slice_rows: int = 1_000_000) -> DataFrame:
    """Add `into`: running numbers as text in the order of a column (unique numbers).

    Rows are numbered within slices of positions and shifted by the slices before, so no task orders the whole table.
    """
    from .recon import ranked

    every_row, at = free_name([*df.columns, into], "all"), free_name([*df.columns, into], "rank")
    rank = ranked(df.withColumn(every_row, F.lit(0)), [every_row], order, slice_rows, at).drop(every_row)
    n = (F.lit(start) + (F.col(at) - 1) * F.lit(increment)).cast("bigint")
    text = n.cast("string")
    if padding > 0:
        sign = F.when(n < 0, "-").otherwise("")
        digits = F.abs(n).cast("string")
        width = F.greatest(F.lit(padding) - F.length(sign), F.length(digits))
        text = F.concat(sign, F.lpad(digits, width, F.lit("0")))
    return rank.withColumn(into, F.concat(F.lit(prefix), text, F.lit(suffix))).drop(at)


@dataclass(frozen=True)
class ColumnMap:
    """A mapping of the older engine: direct, static, expression, conditional, function or aggregate. Lookups and sequences
    add columns before (lookup, sequence).

    aggregate: `value` names one of AGGREGATES, `source` the column (of the rows of a group; any for count_rows).
    """

    target: str
    kind: str = "direct"
    source: str = ""
    value: Any = None
    formula: str = ""
    variables: Mapping[str, str] = field(default_factory=dict)
    condition: str = ""
    other: Any = None


#: Functions that a `function` mapping may name: they take the source columns and give a Column.
FUNCTIONS: dict[str, Callable[..., Column]] = {}


def register(name: str, function: Callable[..., Column]) -> None:
    """Make a function (built from Spark functions, or a UDF) known to `function` mappings."""
    FUNCTIONS[name] = function


#: What an `aggregate` mapping may do with the values of a group; nulls don't count. median is added by an own plan.
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "average": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp, "count": F.count, "count_distinct": F.count_distinct, "count_rows": lambda c: F.count("*"),
}
_OF_NUMBERS = ("sum", "average", "std", "median")


def _aggregated(df: DataFrame, mappings: Sequence[ColumnMap]) -> DataFrame:
    """One row for each combination of the plain columns (one in all without any), with aggregates of its rows."""
    plain, folded = [m for m in mappings if m.kind != "aggregate"], [m for m in mappings if m.kind == "aggregate"]
    keys = [m.target for m in plain]
    taken, values = [*df.columns, *(m.target for m in mappings)], []
    for m in folded:
        if m.value not in AGGREGATES and m.value != "median":
            raise ValueError(f"unknown aggregate {m.value!r}; known: {', '.join(AGGREGATES)}, median")
        path = _path(df, m.source)
        if path not in df.columns and m.value != "count_rows":
            raise ValueError(f"the aggregate {m.target} needs a column of the table, not {m.source!r}")
        c = F.lit(None) if m.value == "count_rows" else F.col(q(path))
        if m.value in _OF_NUMBERS and not is_number(type_of(df, path)):
            c = text_number(text_of(df, path))
        taken.append(free_name(taken, "value"))
        values.append(c.alias(taken[-1]))
    own = taken[len(taken) - len(folded):]
    rows = df.select(*[c.alias(m.target) for m, c in zip(plain, _mapped(df, plain))], *values)
    out = rows.groupBy(*[q(k) for k in keys]).agg(F.count("*").alias(n := free_name(taken, "rows")), *[AGGREGATES[m.value](F.col(q(v))).alias(m.target) for m, v in zip(folded, own) if m.value != "median"])
    for m, v in zip(folded, own):
        if m.value == "median":
            middle = percentiles(rows, keys, v, {m.target: 0.5})
            others = [free_name([*taken, n, *out.columns], f"key{i}") for i in range(len(keys))]
            middle = middle.select(*[F.col(q(k)).alias(o) for k, o in zip(keys, others)], F.col(q(m.target)))
            out = out.join(middle, every([F.col(q(k)).eqNullSafe(F.col(o)) for k, o in zip(keys, others)]), "left") if keys else out.crossJoin(middle)  # without keys one row each
    return out.select(*[q(m.target) for m in mappings])


def _path(df: DataFrame, source: str) -> str:
    return source if source in df.columns else source.rpartition(".")[2]


def map_columns(df: DataFrame, mappings: Sequence[ColumnMap]) -> DataFrame:
    """The mapped columns, in order; a path alias.column means its column. If there are aggregates, the other columns say
    which rows belong together."""
    if any(m.kind == "aggregate" for m in mappings):
        return _aggregated(df, mappings)
    return df.select(*[c.alias(m.target) for m, c in zip(mappings, _mapped(df, mappings))])


def _mapped(df: DataFrame, mappings: Sequence[ColumnMap]) -> list[Column]:
    out = []
    for m in mappings:
        path = _path(df, m.source)
        if m.kind == "direct":
            c = F.col(q(path)) if path in df.columns else F.lit(None)
        elif m.kind == "static":
            c = F.lit(m.value)
        elif m.kind == "expression":
            text = m.formula
            for name in m.variables:
                text = text.replace("{" + name + "}", name)
            c = formula(df, text, m.variables).column
        elif m.kind == "conditional":
            c = F.when(condition(df, m.condition), F.lit(m.value)).otherwise(F.lit(m.other))
        elif m.kind == "function":
            if m.value not in FUNCTIONS:
                raise ValueError(f"no function {m.value!r} is registered")
            c = FUNCTIONS[m.value](*[F.col(q(s.strip())) for s in m.source.split(",")])
        else:
            raise ValueError(f"unknown mapping {m.kind!r}")
        out.append(c)
    return out


# --------------------------------------------------------- validation and output


@dataclass(frozen=True)
class OutputColumn:
    """An output column's definition. decimals and date_format are output formats."""

    name: str
    allowed: Sequence[Any] = ()
    default: Any = None
    decimals: int | None = None
    date_format: str | None = None
    text: bool = False


@dataclass(frozen=True)
class Check:
    kind: str  # required or format
    column: str
    pattern: str = ""
    severity: str = "error"


def validate(df: DataFrame, columns: Sequence[OutputColumn], checks: Sequence[Check] = ()) -> dict[str, Any]:
    """errors, warnings and passed; all violations are counted in one aggregate over the table."""
    errors, warnings = [], []
    if missing := [c.name for c in columns if c.name not in df.columns]:
        errors.append(f"Missing required columns: {', '.join(missing)}")
    counts: list[tuple[Column, str, str]] = []
    for c in columns:
        if c.name in df.columns and c.allowed:
            value = F.col(q(c.name))
            counts.append((F.count_if(value.isNotNull() & ~value.isin(list(c.allowed))), "warning", f"Column '{c.name}' contains values not in allowed list"))
    for k in checks:
        if k.column not in df.columns:
            continue
        if k.kind == "required":
            counts.append((F.count_if(F.col(q(k.column)).isNull()), k.severity, f"Column '{k.column}' has {{n}} null values"))
        elif k.kind == "format":
            text = F.coalesce(text_of(df, k.column), F.lit("nan"))
            counts.append((F.count_if(~text.rlike(f"^(?:{k.pattern})")), k.severity, f"Column '{k.column}' has {{n}} values not matching pattern"))
        else:
            raise ValueError(f"unknown check {k.kind!r}; known: required, format")
    if counts:
        row = df.agg(*[c.alias(f"c{i}") for i, (c, _, _) in enumerate(counts)]).first()
        for n, (_, severity, text) in zip(row, counts):
            if n:
                (errors if severity == "error" else warnings).append(text.format(n=n))
    return {"errors": errors, "warnings": warnings, "passed": not errors}


def formatted(df: DataFrame, columns: Sequence[OutputColumn]) -> DataFrame:
    """The defined columns in order: defaults for missing ones, rounded numbers, formatted dates, or text."""
    out = []
    for c in columns:
        if c.name not in df.columns:
            value = F.lit(c.default)
        elif c.decimals is not None:
            value = F.round(F.col(q(c.name)), c.decimals)
        elif c.date_format:
            value = F.date_format(F.to_date(date_of(df, c.name)), c.date_format)
        else:
            value = text_of(df, c.name) if c.text else F.col(q(c.name))
        out.append(value.alias(c.name))
    return df.select(*out)
