"""Functions that queries written for another SQL dialect use, as temporary SQL functions of the session.

They are plain SQL bodies, so Catalyst inlines them; `similarity` alone is a pandas UDF. regexp_extract and
regexp_replace exist in Spark with other defaults: regexp_find takes the whole match, regexp_replace_first the first one.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .similarity import text_score

FUNCTIONS = {
    "regexp_matches": ("s STRING, p STRING", "BOOLEAN", "s RLIKE p"),
    "regexp_find": ("s STRING, p STRING", "STRING", "regexp_extract(s, p, 0)"),
    "regexp_replace_first": ("s STRING, p STRING, r STRING", "STRING", "if(regexp_instr(s, p) = 0, s, concat(left(s, regexp_instr(s, p) - 1), r, substr(s, regexp_instr(s, p) + length(regexp_extract(s, p, 0)))))"),
    "split_text": ("s STRING, d STRING", "ARRAY<STRING>", r"split(s, concat('\\Q', d, '\\E'))"),
    "strptime": ("s STRING, f STRING", "TIMESTAMP", "try_to_timestamp(s, replace(replace(replace(replace(replace(replace(replace(replace(f, '%Y', 'yyyy'), '%y', 'yy'), '%m', 'MM'), '%d', 'dd'), '%b', 'MMM'), '%H', 'HH'), '%M', 'mm'), '%S', 'ss'))"),
    "days_between": ("a DATE, b DATE", "INT", "datediff(a, b)"),
    "safe_divide": ("a DOUBLE, b DOUBLE", "DOUBLE", "try_divide(a, b)"),
}


def install(spark: SparkSession) -> list[str]:
    """Define the functions in the session; their names."""
    for name, (args, gives, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {gives} RETURN {body}")
    spark.udf.register("similarity", text_score)
    return [*FUNCTIONS, "similarity"]
