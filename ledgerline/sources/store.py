"""Stored tables and results: versions of a table, each a folder of Parquet, and a log of commits with their metadata.

A version is written to a folder of its own and counts once its commit file exists, so a table may be replaced by what is
still being read from it, and a write that fails leaves the version before. Commits are numbered; a number is taken by
creating its file, which only one writer can do. Results are partitioned by category, so reading one category reads its
files alone, and listings read commits only. Paths are in any store that Spark reaches.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Mapping
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.profile import union_all
from ..session import q

CONTAINERS = ("uploaded_files", "extractions", "comparisons", "reconciliations", "transformations", "queries")
CATEGORY = "result_category"
_META = "id string, container string, kind string, name string, created double, rows bigint, columns string, counts string, extra string, version bigint, folder string"
#: How often an update that others came before is tried again.
ATTEMPTS = 20


class Conflict(RuntimeError):
    """Another version was committed since the one that a write builds on."""


def safe_name(name: str, fallback: str = "result") -> str:
    """Letters, digits, dots, dashes and underscores only."""
    return re.sub(r"_+", "_", re.sub(r"[^A-Za-z0-9._-]", "_", name)).strip("._") or fallback


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _path(self, container: str, kind: str, id: str) -> str:
        if container not in CONTAINERS:
            raise ValueError(f"no container {container!r}")
        return f"{self.root}/{container}/{kind}/{id}"

    def _commits(self, container: str, id: str) -> dict[int, str]:
        """The commit files of a table by number."""
        fs, where = self._fs(self._path(container, "meta", id))
        if not fs.exists(where):
            return {}
        found = [(re.fullmatch(r"([0-9]{12})\.json", f.getPath().getName()), f.getPath().toString()) for f in fs.listStatus(where)]
        return {int(m[1]): path for m, path in found if m}

    def _commit(self, container: str, meta: dict[str, Any]) -> bool:
        """Take the meta's version number; False if it is taken.

        Stores create a file that is not there in one step; a local disk does so by createNewFile only.
        """
        fs, where = self._fs(f"{self._path(container, 'meta', meta['id'])}/{meta['version']:012d}.json")
        local = where.toUri().getScheme() in (None, "file") and fs.getUri().getScheme() == "file"
        if local:
            fs.mkdirs(where.getParent())
            if not self.spark.sparkContext._jvm.java.io.File(where.toUri().getPath()).createNewFile():
                return False
        try:
            out = fs.create(where, local)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName() or fs.exists(where):
                return False
            raise
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()
        return True

    def version(self, container: str, id: str) -> int:
        """The number of the newest version, 0 if the table doesn't exist."""
        return max(self._commits(container, id), default=0)

    def put(self, container: str, df: DataFrame, name: str = "", id: str | None = None, partition: str | None = None, expected: int | None = None, **extra: Any) -> str:
        """Store a table, or a new version of it; with `partition`, by that column. The id.

        expected: the version that this one builds on; Conflict if another has been committed since. Without it, the last
        one to commit counts. Versions before stay readable until vacuum().
        """
        id = id or uuid.uuid4().hex
        folder = f"{self._path(container, 'data', id)}/{uuid.uuid4().hex}"
        try:
            writer = df.write
            (writer.partitionBy(partition) if partition else writer).parquet(folder)
            back = self.spark.read.schema(df.schema).parquet(folder)
            counts = {r[0]: r[1] for r in back.groupBy(q(partition)).agg(F.count("*")).collect()} if partition else {}
            rows = sum(counts.values()) if partition else back.count()  # from Parquet's footers
            meta = {
                "id": id, "container": container, "kind": "partitioned" if partition else "table", "name": name or id, "created": time.time(), "rows": rows, "columns": json.dumps([[f.name, f.dataType.simpleString()] for f in df.schema]),
                "counts": json.dumps(counts), "extra": json.dumps(extra), "folder": folder}
            while True:
                newest = self.version(container, id)
                if expected is not None and newest != expected:
                    raise Conflict(f"{container}/{id} is at version {newest}, not {expected}")
                if self._commit(container, meta | {"version": newest + 1}):
                    return id
        except BaseException:
            fs, where = self._fs(folder)
            fs.delete(where, True)
            raise

    def update(self, container: str, id: str, change: Callable[[DataFrame], DataFrame], attempts: int = ATTEMPTS) -> int:
        """Replace a table by what `change` makes of it; when another version comes between, again from that one. The new version."""
        for _ in range(attempts):
            meta = self.describe(container, id)
            try:
                self.put(container, change(self.get(container, id, version=meta["version"])), meta["name"], id, CATEGORY if meta["kind"] == "partitioned" else None, meta["version"], **meta["extra"])
                return meta["version"] + 1
            except Conflict:
                continue
        raise Conflict(f"{container}/{id} changed {attempts} times meanwhile")

    def vacuum(self, container: str, id: str, keep: int = 1) -> int:
        """Delete the data of all but the newest `keep` versions, and of writes that never ended; how many folders went.

        For a time when nothing reads or writes the table.
        """
        metas = [m for _, path in sorted(self._commits(container, id).items()) if (m := self._committed(path))]
        kept = {m["folder"].rsplit("/", 1)[1] for m in metas[-keep:]}
        fs, where = self._fs(self._path(container, "data", id))
        old = [f.getPath() for f in fs.listStatus(where) if f.getPath().getName() not in kept]
        for path in old:
            fs.delete(path, True)
        return len(old)

    def _text(self, path: str) -> str:
        fs, where = self._fs(path)
        stream = fs.open(where)
        try:
            return bytes(stream.readNBytes(1 << 30)).decode()
        finally:
            stream.close()

    def put_results(self, container: str, results: Mapping[str, DataFrame], name: str = "", id: str | None = None, **extra: Any) -> str:
        """Store result sets that share columns, or have columns of their own, as categories of one table."""
        return self.put(container, union_all(list(results.values()), CATEGORY, list(results)), name, id, CATEGORY, **extra)

    def get(self, container: str, id: str, category: str | None = None, version: int | None = None) -> DataFrame:
        """A table, or a category of it; the newest version unless another is named."""
        meta = self.describe(container, id, version)
        df = self.spark.read.parquet(meta["folder"]) if meta["kind"] == "partitioned" else self.spark.read.schema(", ".join(f"{q(c)} {t}" for c, t in meta["columns"])).parquet(meta["folder"])
        return df.filter(F.col(CATEGORY) == category).drop(CATEGORY) if category else df

    def exists(self, container: str, id: str) -> bool:
        return bool(self._commits(container, id))

    def delete(self, container: str, id: str) -> bool:
        found = self.exists(container, id)
        for kind in ("meta", "data"):
            fs, where = self._fs(self._path(container, kind, id))
            fs.delete(where, True)
        return found

    def metadata(self, container: str | None = None) -> DataFrame:
        """A row for each stored table, newest first; no data is read."""
        names = [container] if container else CONTAINERS
        each = []
        for c in names:
            fs, where = self._fs(f"{self.root}/{c}/meta")
            if fs.exists(where) and len(fs.listStatus(where)):
                each.append(self.spark.read.schema(_META).json(f"{self.root}/{c}/meta/*/*.json"))
        out = union_all(each) if each else self.spark.createDataFrame([], _META)
        newest = out.filter("version IS NOT NULL").groupBy("container", "id").agg(F.max_by(F.struct(*out.columns), F.col("version")).alias("r")).select("r.*")
        return newest.orderBy(F.desc("created"), "id")

    def describe(self, container: str, id: str, version: int | None = None) -> dict[str, Any]:
        """What the log says of a version, the newest by default; KeyError if there is none."""
        commits = self._commits(container, id)
        if not commits or (version is not None and version not in commits):
            raise KeyError(f"{container} has no {id}" + (f" of version {version}" if version is not None else ""))
        for number in [version] if version is not None else sorted(commits, reverse=True):
            if meta := self._committed(commits[number]):
                return meta | {k: json.loads(meta[k]) for k in ("columns", "counts", "extra")}
        raise KeyError(f"{container}/{id} has no whole commit")

    def _committed(self, path: str) -> dict[str, Any] | None:
        """A commit; one that is just being written is waited for, one whose writer was lost counts for nothing."""
        for _ in range(20):
            try:
                return json.loads(self._text(path))
            except ValueError:
                time.sleep(0.1)
        return None

    def find(self, text: str, container: str | None = None) -> DataFrame:
        """Stored tables whose name contains the text, without case."""
        return self.metadata(container).filter(F.contains(F.lower("name"), F.lit(text.lower())))

    def clear_old(self, container: str, keep: int) -> int:
        """Delete all but the newest `keep`; how many went."""
        old = [r["id"] for r in self.metadata(container).select("id").offset(keep).collect()]  # ids of metadata rows
        for id in old:
            self.delete(container, id)
        return len(old)

    def save_result(self, container: str, id: str, category: str | None = None, name: str | None = None) -> str:
        """A result set as an uploaded table of its own."""
        label = safe_name(name or f"{container}_{id[:8]}_{category or 'all'}")
        return self.put("uploaded_files", self.get(container, id, category), label, source=f"{container}/{id}/{category or 'all'}")
