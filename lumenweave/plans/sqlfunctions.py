"""The band arithmetic as SQL functions, so that every session's SQL can use it. Catalyst inlines them: no UDF is called."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name: parameters, type, body.
FUNCTIONS = {
    "lw_finite": ("v DOUBLE", "BOOLEAN", "v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity')"),
    "lw_clip": ("v DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "CASE WHEN v IS NOT NULL THEN least(greatest(v, low), high) END"),
    "lw_nd": ("a DOUBLE, b DOUBLE", "DOUBLE", "CASE WHEN abs(a + b) >= 1e-3D THEN (a - b) / (a + b) END"),
    "lw_depth": ("centre DOUBLE, left_shoulder DOUBLE, right_shoulder DOUBLE, share DOUBLE", "DOUBLE", "CASE WHEN left_shoulder + (right_shoulder - left_shoulder) * share > 0 THEN least(greatest(1 - centre / (left_shoulder + (right_shoulder - left_shoulder) * share), 0D), 1D) END"),
    "lw_dnbr_class": ("dnbr DOUBLE", "INT", "CASE WHEN dnbr IS NOT NULL THEN int(dnbr >= 0.10D) + int(dnbr >= 0.27D) + int(dnbr >= 0.44D) + int(dnbr >= 0.66D) END"),
    "lw_cbi_class": ("cbi DOUBLE", "INT", "CASE WHEN cbi IS NOT NULL THEN int(cbi >= 0.10D) + int(cbi >= 1.00D) + int(cbi >= 1.50D) + int(cbi >= 2.25D) END"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
