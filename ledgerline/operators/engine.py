"""A transformation as one chain: expand rows, look up, number, map (row by row or as aggregates of groups), check, format.

The chain is one plan; nothing runs before its rows or its findings are asked for.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame

from ..session import require
from . import transform
from .transform import Check, ChosenRule, ColumnMap, OutputColumn

PREVIEW_ROWS = 10


@dataclass(frozen=True)
class Lookup:
    """Add `into` from another source: `take` of its first row (by `pos`) whose `key` equals `column`, else the default."""

    source: str
    column: str
    key: str
    take: str
    into: str
    default: Any = None
    pos: str | None = None


@dataclass(frozen=True)
class Numbering:
    """Add `into`: running numbers as text in the order of a column of unique numbers."""

    order: str
    into: str
    start: int = 1
    increment: int = 1
    prefix: str = ""
    suffix: str = ""
    padding: int = 0


@dataclass(frozen=True)
class Chain:
    """The steps, in the order they are taken. primary: the source whose rows are transformed, the first by default."""

    mappings: Sequence[ColumnMap]
    columns: Sequence[OutputColumn] = ()
    expansions: Sequence[ChosenRule] = ()
    lookups: Sequence[Lookup] = ()
    numberings: Sequence[Numbering] = ()
    checks: Sequence[Check] = ()
    primary: str | None = None


class Outcome:
    """rows: what the chain gives. findings: errors, warnings and passed, from one aggregate over the mapped rows."""

    def __init__(self, mapped: DataFrame, chain: Chain):
        self._mapped, self._chain = mapped, chain
        self.rows = transform.formatted(mapped, chain.columns) if chain.columns else mapped

    @cached_property
    def findings(self) -> dict[str, Any]:
        return transform.validate(self._mapped, self._chain.columns, self._chain.checks)

    def preview(self, rows: int | None = None) -> DataFrame:
        """The first rows; the limit reaches the scan where the chain has no aggregate."""
        return self.rows.limit(PREVIEW_ROWS if rows is None else max(rows, 0))


def run(sources: Mapping[str, DataFrame], chain: Chain) -> Outcome:
    """Take the primary source through the chain.

    Each row is expanded by the first enabled rule, by priority, whose condition holds, and stays single without one;
    _expansion_index numbers its copies and may be mapped. Lookups go to the other sources by name. Numberings order all
    expanded rows. Columns that the output defines but no mapping makes get their defaults, and are an error in the findings.
    """
    if not sources:
        raise ValueError("a chain needs a source")
    name = chain.primary or next(iter(sources))
    if missing := [n for n in [name, *(x.source for x in chain.lookups)] if n not in sources]:
        raise ValueError(f"no source {missing[0]!r}; there are {', '.join(sources)}")
    rows = sources[name]
    if chain.expansions:
        rows = transform.expand_by_rule(rows, chain.expansions)
    for x in chain.lookups:
        rows = transform.lookup(rows, sources[x.source], x.column, x.key, x.take, x.into, x.default, x.pos)
    for x in chain.numberings:
        require(rows, [x.order], "the table")
        rows = transform.sequence(rows, x.order, x.into, x.start, x.increment, x.prefix, x.suffix, x.padding)
    return Outcome(transform.map_columns(rows, chain.mappings), chain)


def preview(outputs: Mapping[str, DataFrame], rows: int | None = None) -> DataFrame:
    """The first rows of the first output of transform.transform."""
    return next(iter(outputs.values())).limit(PREVIEW_ROWS if rows is None else max(rows, 0))
