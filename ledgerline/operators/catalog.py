"""Catalogues of rules, templates, prompts and runs: tables of metadata, queried with DataFrame operations.

Rows are kept in a `Catalog`, a Parquet folder that is only added to: a change appends a version, of which the newest of an
id counts; a use or a rating appends an event, and events are summed, so concurrent ones all count. compact() writes what they
come to into a new folder. Search, ranking and summaries work on any DataFrame with the columns they name.
"""

from __future__ import annotations

import difflib
import json
import re
import time
import uuid
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import free_name

SCHEMA = (
    "id string, version bigint, deleted boolean, type string, category string, name string, description string, tags array<string>, columns array<string>, "
    "body string, template_id string, usage bigint, rating double, rating_count bigint, quality double, created double, updated double, event string"
)
# How usage and ratings weigh, and how much each likeness of a template counts.
USAGE_WEIGHT, RATING_WEIGHT = 0.7, 0.3
SCORES = {"type": 0.4, "category": 0.2, "tags": 0.2, "columns": 0.15, "popularity": 0.05}
LEAST_SCORE, POPULAR_USES = 0.3, 100
#: US dollars for a thousand tokens, by model; to be given by the caller.
RATES: dict[str, tuple[float, float]] = {}


class Catalog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _append(self, rows: Sequence[dict[str, Any]]) -> None:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        data = [tuple(r.get(n) for n in names) for r in rows]
        self._write(self.spark.createDataFrame(data, SCHEMA).coalesce(1))

    def _write(self, df: DataFrame) -> None:
        df.write.parquet(f"{self.path}/{uuid.uuid4().hex}")  # writers of one folder would clear each other's files away

    def versions(self) -> DataFrame:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/*/*.parquet")

    def entries(self) -> DataFrame:
        """The newest version of each entry that isn't deleted, without the events since."""
        df = self.versions().filter("event IS NULL")
        newest = df.groupBy("id").agg(F.max_by(F.struct(*df.columns), F.col("version")).alias("r"))
        return newest.select("r.*").filter(~F.coalesce("deleted", F.lit(False)))

    def rows(self) -> DataFrame:
        """Entries with their uses and ratings counted up."""
        zero = lambda c: F.coalesce(c, F.lit(0))
        events = self.versions().filter("event IS NOT NULL").groupBy("id").agg(F.sum("usage").alias("_uses"), F.sum("rating").alias("_stars"), F.sum("rating_count").alias("_ratings"))
        ratings = zero("rating_count") + zero("_ratings")
        mean = F.when(ratings > 0, (zero("rating") * zero("rating_count") + zero("_stars")) / ratings).otherwise(zero("rating").cast("double"))
        counted = {"usage": zero("usage") + zero("_uses"), "rating": mean, "rating_count": ratings}
        base = self.entries()
        return base.join(events, "id", "left").select(*[counted[c].alias(c) if c in counted else c for c in base.columns])

    def save(self, entries: Sequence[Mapping[str, Any]]) -> list[str]:
        """Add or replace entries (with an id); `body` may be any JSON value. The ids."""
        now, out = time.time(), []
        for e in entries:
            body = e.get("body")
            out.append({"usage": 0, "rating": 0.0, "rating_count": 0, "created": now, "updated": now, "deleted": False, "version": time.time_ns()} | dict(e) | {"id": e.get("id") or uuid.uuid4().hex, "body": body if isinstance(body, (str, type(None))) else json.dumps(body)})
        self._append(out)
        return [r["id"] for r in out]

    def get(self, id: str) -> dict[str, Any] | None:
        row = self.rows().filter(F.col("id") == id).first()
        return row.asDict(True) if row else None

    def _entry(self, id: str) -> dict[str, Any] | None:
        row = self.entries().filter(F.col("id") == id).first()
        return row.asDict(True) if row else None

    def update(self, id: str, **changes: Any) -> bool:
        old = self._entry(id)
        if old is None:
            return False
        self._append([old | changes | {"version": time.time_ns(), "updated": time.time()}])
        return True

    def delete(self, ids: Sequence[str]) -> int:
        found = [r.asDict(True) for r in self.entries().filter(F.col("id").isin(list(ids))).collect()]
        if found:
            self._append([r | {"deleted": True, "version": time.time_ns()} for r in found])
        return len(found)

    def used(self, id: str) -> bool:
        if self._entry(id) is None:
            return False
        self._append([{"id": id, "event": "used", "usage": 1}])
        return True

    def rate(self, id: str, rating: float) -> bool:
        """Add a rating; the entry shows the mean of all."""
        if self._entry(id) is None:
            return False
        self._append([{"id": id, "event": "rated", "rating": float(rating), "rating_count": 1}])
        return True

    def compact(self, to: str) -> Catalog:
        """A copy without old versions, in a new folder."""
        copy = Catalog(self.spark, to)
        copy._write(self.rows())
        return copy


# ------------------------------------------------------------- lists and search


def listed(rows: DataFrame, type: str | None = None, category: str | None = None, template_id: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """Newest first, a page of them."""
    for name, value in (("type", type), ("category", category), ("template_id", template_id)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    return rows.orderBy(F.desc("created"), "id").offset(offset).limit(limit)


def searched(rows: DataFrame, text: str | None = None, category: str | None = None, tags: Sequence[str] = (), least_usage: int = 0, limit: int = 50) -> DataFrame:
    """By text in name or description, category, any of the tags and usage; most used first, then newest."""
    if text:
        low = F.lit(text.lower())
        rows = rows.filter(F.coalesce(F.contains(F.lower("name"), low), F.lit(False)) | F.coalesce(F.contains(F.lower("description"), low), F.lit(False)))
    if category:
        rows = rows.filter(F.col("category") == category)
    if tags:
        rows = rows.filter(F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, tags))), F.lit(False)))
    if least_usage:
        rows = rows.filter(F.col("usage") >= least_usage)
    return rows.orderBy(F.desc("usage"), F.desc("updated"), "id").limit(limit)


def categories(rows: DataFrame) -> DataFrame:
    return rows.filter("category is not null and category <> ''").select("category").distinct().orderBy("category")


def by_merit(rows: DataFrame, limit: int = 50) -> DataFrame:
    """By usage and rating."""
    return rows.withColumn("merit", F.col("usage") * USAGE_WEIGHT + F.col("rating") * RATING_WEIGHT).orderBy(F.desc("merit"), "id").limit(limit)


def popular(rows: DataFrame, limit: int = 10) -> DataFrame:
    """By usage and all ratings given."""
    return rows.withColumn("popularity", F.col("usage") * USAGE_WEIGHT + F.col("rating") * F.col("rating_count") * RATING_WEIGHT).orderBy(F.desc("popularity"), "id").limit(limit)


def prompts(rows: DataFrame, by_quality: bool = False) -> DataFrame:
    order = [F.desc("quality"), F.desc("created")] if by_quality else [F.desc("created")]
    return rows.filter(F.col("type") == "prompt").orderBy(*order, "id")


def suited(rows: DataFrame, type: str | None = None, category: str | None = None, tags: Sequence[str] = (), columns: Sequence[str] = (), limit: int = 10) -> DataFrame:
    """Templates by how well they suit: the weighted likeness of type, category, tags, columns and popularity."""

    def share(name: str, wanted: Sequence[str]) -> Column:
        if not wanted:
            return F.lit(0.0)
        has = F.transform(F.coalesce(F.col(name), F.array().cast("array<string>")), F.lower)
        return F.size(F.array_intersect(has, F.array(*[F.lit(w.lower()) for w in dict.fromkeys(wanted)]))) / len(set(wanted))

    same = lambda name, value: F.coalesce((F.col(name) == value).cast("double"), F.lit(0.0)) if value else F.lit(0.0)
    parts = {"type": same("type", type), "category": same("category", category), "tags": share("tags", tags), "columns": share("columns", columns), "popularity": F.least(F.coalesce("usage", F.lit(0)) / POPULAR_USES, F.lit(1.0))}
    score = sum((parts[k] * w for k, w in SCORES.items()), F.lit(0.0))
    return rows.withColumn("score", F.round(score, 6)).filter(F.col("score") > LEAST_SCORE).orderBy(F.desc("score"), "id").limit(limit)


# --------------------------------------------------------- templates with parameters

# Words that may stand for each other in column names.
SYNONYMS = {
    "amount": ("value", "total", "sum", "price", "cost"),
    "reference": ("ref", "id", "number", "identifier"),
    "date": ("time", "timestamp", "created", "updated"),
    "description": ("desc", "name", "title", "details"),
}


def map_columns(wanted: Sequence[str], columns: Sequence[str], least: float = 0.8) -> dict[str, str]:
    """Which column each wanted name means: exact, then part of each other, then by synonyms, then by spelling."""
    low = {c.lower(): c for c in columns}

    def means(name: str, column: str) -> bool:
        """A synonym of the name is in the column's, or the name is a synonym of a word in it."""
        return any(s in column for s in SYNONYMS.get(name, ())) or any(word in column and name in own for word, own in SYNONYMS.items())

    out = {}
    for w in wanted:
        x = w.lower()
        found = low.get(x) or next((c for k, c in low.items() if x in k or k in x), None)
        if not found:
            found = next((c for k, c in low.items() if means(x, k)), None)
        if not found:
            near = difflib.get_close_matches(x, low, n=1, cutoff=least)
            found = low[near[0]] if near else None
        if found:
            out[w] = found
    return out


def resolved(parameters: Sequence[Mapping[str, Any]], given: Mapping[str, Any]) -> dict[str, Any]:
    """The value of each declared parameter: given, or its default; an error for a required one without either."""
    out, missing = {}, []
    for p in parameters:
        if p["name"] in given:
            out[p["name"]] = given[p["name"]]
        elif "default" in p:
            out[p["name"]] = p["default"]
        elif p.get("required", True):
            missing.append(p["name"])
    if missing:
        raise ValueError(f"no value for {', '.join(missing)}")
    return out


def filled(text: str, columns: Mapping[str, str] | None = None, names: Sequence[str] = ()) -> str:
    """A stored query with {{column}} placeholders as quoted names and {{parameter}} placeholders as :parameter markers."""

    def put(m: re.Match) -> str:
        name = m.group(1).strip()
        if name in (columns or {}):
            return '"' + columns[name].replace('"', '""') + '"'
        if name in names:
            return ":" + name
        raise ValueError(f"nothing given for {{{{{name}}}}}")

    return re.sub(r"\{\{([^}]+)\}\}", put, text)


def execute(template: Mapping[str, Any], tables, given: Mapping[str, Any] | None = None, wanted: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Run a stored query on open tables (operators.sqlsurface): columns mapped to theirs, parameters bound as values."""
    from . import sqlsurface

    known = [c for v in tables.views for c in tables.spark.table(v).columns]
    mapping = map_columns(wanted, known)
    if missing := [w for w in wanted if w not in mapping]:
        raise ValueError(f"no column for {', '.join(missing)}")
    values = resolved(template.get("parameters") or [], given or {})
    return sqlsurface.run(tables, filled(template["body"], mapping, list(values)), limit, values or None)


# -------------------------------------------------------------------------- runs


def cost(model: str, prompt_tokens: int, answer_tokens: int, rates: Mapping[str, tuple[float, float]] = RATES) -> float | None:
    """US dollars by the given rates; None for a model without any."""
    if model not in rates:
        return None
    a, b = rates[model]
    return prompt_tokens / 1000 * a + answer_tokens / 1000 * b


def run_summary(runs: DataFrame) -> DataFrame:
    """One row: runs, successes, success rate in per cent, mean and total seconds, mean rows. runs: status, seconds, rows."""
    ok = F.count_if(F.col("status") == "success")
    n = F.count("*")
    return runs.agg(
        n.alias("total_runs"), ok.alias("successful_runs"), F.round(F.when(n > 0, ok / F.greatest(n, F.lit(1)) * 100).otherwise(F.lit(0.0)), 2).alias("success_rate"),
        F.round(F.avg("seconds"), 4).alias("average_seconds"), F.round(F.sum("seconds"), 4).alias("total_seconds"), F.round(F.avg("rows"), 4).alias("average_rows"))


def runs_by_type(runs: DataFrame) -> DataFrame:
    return runs.groupBy("type").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "success").alias("successful_runs"), F.round(F.avg("seconds"), 4).alias("average_seconds"))


def latest(runs: DataFrame, n: int = 10, time_col: str = "started", id_col: str = "run_id") -> DataFrame:
    return runs.orderBy(F.desc(time_col), id_col).limit(n)


def newest_per_type(runs: DataFrame, keep: int, time_col: str = "started", id_col: str = "run_id") -> DataFrame:
    """The newest `keep` runs of each type: what clearing old ones leaves."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("type").orderBy(F.desc(time_col), id_col))
    place = free_name(runs, "nth")
    return runs.withColumn(place, nth).filter(F.col(place) <= keep).drop(place)
