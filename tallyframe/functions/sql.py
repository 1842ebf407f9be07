"""Text functions by name in SQL: definitions that Spark inlines into a query's plan, and one Python function."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import text as tx

#: Name, parameters, type and body; bodies may use the functions before them.
DEFINITIONS = (
    ("tr_upper", "s STRING", "STRING", "upper(translate(s, 'iı', 'İI'))"),
    ("tr_lower", "s STRING", "STRING", "lower(translate(s, 'Iİ', 'ıi'))"),
    ("ascii_fold", "s STRING", "STRING", f"translate(s, '{tx.DIACRITICS}', '{tx.SHADOWS}')"),
    ("norm_ws", "s STRING", "STRING", r"lower(trim(regexp_replace(s, r'\s+', ' ')))"),
    ("words_of", "s STRING", "ARRAY<STRING>", r"regexp_extract_all(s, r'(?U)\w+', 0)"),
    ("per_hundred", "hits BIGINT, n BIGINT", "DOUBLE", "CASE WHEN n = 0 THEN 0.0D ELSE hits * 100.0D / nullif(n, 0) END"),
    ("scaled", "x DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "CASE WHEN high <= low THEN 0.0D ELSE greatest(0.0D, least(10.0D, (x - low) / nullif(high - low, 0.0D) * 10)) END"),
    ("rate_points", "wps DOUBLE", "DOUBLE", "CASE WHEN wps <= 2.0D OR wps >= 4.5D THEN 0.0D WHEN wps <= 3.2D THEN scaled(wps, 2.0D, 3.2D) ELSE scaled(4.5D - wps, 0.0D, 4.5D - 3.2D) END"),
    ("set_similarity", "a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "CASE WHEN size(array_union(a, b)) = 0 THEN 0.0D ELSE size(array_intersect(a, b)) / CAST(size(array_union(a, b)) AS DOUBLE) END"),
)


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session; those of a name that is there already are replaced."""
    for name, parameters, kind, body in DEFINITIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udf.register("nfc", tx.nfc)
