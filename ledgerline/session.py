"""Sessions with the settings that the library's results depend on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Read by all operators: names may differ in case only, times are UTC, bad casts are errors unless try_ is used.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(name: str = "ledgerline", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all machines share; where it is unset, a temporary one on a single machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="ledgerline-")
    return named.rstrip("/")


def q(name: str) -> str:
    """A column name as one identifier, whatever dots, spaces or backticks it holds."""
    return "`" + name.replace("`", "``") + "`"


def free_name(taken: DataFrame | list[str], base: str) -> str:
    """A name for a helper column that no column of the table has, in any case."""
    used = {c.lower() for c in (taken if isinstance(taken, list) else taken.columns)}
    name = f"_{base}"
    while name.lower() in used:
        name += "_"
    return name


def require(df: DataFrame, names: list[str] | tuple[str, ...], what: str) -> None:
    """Raise unless df has all the columns."""
    missing = [n for n in dict.fromkeys(names) if n not in df.columns]
    if missing:
        raise ValueError(f"{what} has no column {', '.join(missing)}; it has {', '.join(df.columns)}")
