"""Authoring aids behind an interface: a provider that the caller brings turns text into text; what it gives is checked here.

No provider is built in. Configurations and queries are only ever data: they are validated before an operator runs them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame

from .operators import delta, recon
from .operators.sqlsurface import column_hints, column_references


class Provider(Protocol):
    """It goes to executors when fields are extracted, so it has to pickle."""

    def complete(self, prompt: str) -> str: ...


def json_of(text: str) -> Any:
    """The JSON value in an answer, with or without a code fence around it."""
    body = text.strip()
    if body.startswith("```"):
        body = body.strip("`").partition("\n")[2].rpartition("\n")[0] or body.strip("`")
    starts = [i for i in (body.find("{"), body.find("[")) if i >= 0]
    if not starts:
        raise ValueError("the answer holds no JSON")
    return json.JSONDecoder().raw_decode(body[min(starts) :])[0]


def recon_rules(provider: Provider, wish: str, a: DataFrame, b: DataFrame) -> list[recon.Rule]:
    """Matching rules for a wish in words, checked against both tables."""
    answer = provider.complete(f"Columns of A: {a.columns}. Columns of B: {b.columns}. Give a JSON list of rules with left, right, kind ({', '.join(recon.KINDS)}) and tolerance for: {wish}")
    rules = [recon.Rule(r["left"], r["right"], r.get("kind", "equals"), r.get("tolerance")) for r in json_of(answer)]
    recon.validate(a, b, rules)
    return rules


def delta_keys(provider: Provider, wish: str, a: DataFrame, b: DataFrame) -> list[delta.Key]:
    answer = provider.complete(f"Columns of the older table: {a.columns}. Columns of the newer: {b.columns}. Give a JSON list of keys with left, right and kind for: {wish}")
    keys = [delta.Key(k["left"], k["right"], k.get("kind", "equals")) for k in json_of(answer)]
    delta.require(a, [k.left for k in keys], "the older table")
    delta.require(b, [k.right for k in keys], "the newer table")
    return keys


def query_for(provider: Provider, wish: str, tables) -> str:
    """A read-only query over open tables (operators.sqlsurface)."""
    from .operators import sqlsurface

    known = {v: tables.spark.table(v).columns for v in tables.views}
    columns = [c for v in known.values() for c in v]
    text = provider.complete(f"Tables: {known}. Columns meant: {column_hints(wish, columns)}. Give one Spark SQL query for: {wish}").strip().strip("`").removeprefix("sql").strip()
    if not sqlsurface.read_only(tables.spark, text):
        raise ValueError("the query doesn't only read")
    return text


def intent_check(query: str, columns: Sequence[str]) -> dict[str, Any]:
    return column_references(query, columns)


def prompt_quality(prompt: str, columns: Sequence[str]) -> float:
    """0 to 1: a prompt is better the more it says: enough words, columns by name, what to do and in which order."""
    words = prompt.lower().split()
    parts = [min(len(words) / 12, 1.0), float(bool(column_hints(prompt, columns))), float(any(w in words for w in ("sum", "total", "count", "average", "compare", "list", "show", "find", "join", "match"))), float(any(w in words for w in ("by", "per", "where", "between", "sorted", "top", "only")))]
    return round(sum(parts) / len(parts), 2)


def extract_fields(df: DataFrame, text: str, fields: Sequence[str], provider: Provider, key: str, batch: int = 100) -> DataFrame:
    """For each row the fields that the provider reads from its text, and its confidence; batches of rows to a call."""
    if not 1 <= batch <= 1000:
        raise ValueError("batch is 1 to 1000")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), batch):
                rows = part.iloc[at : at + batch]
                asked = json.dumps({"fields": list(fields), "texts": rows[text].fillna("").tolist()})
                found = json_of(provider.complete(asked))
                out = pd.DataFrame({key: rows[key].tolist()})
                for f in fields:
                    out[f] = [None if x.get(f) is None else str(x[f]) for x in found]
                out["confidence"] = [float(x.get("confidence", 0.0)) for x in found]
                yield out

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, " + ", ".join(f"`{f}` string" for f in fields) + ", confidence double")
