"""Session settings that the plans here are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: HotSpot leaves methods of over 8000 bytes uncompiled. The power chain as one
#: whole-stage method is larger, so past this size Spark should generate a
#: projection for each operator instead: 600 000 rows of it take about a third
#: of the time.
SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    """The builder with these settings, to be changed after it at will."""
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder
