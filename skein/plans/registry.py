"""Named queries over the driver's tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.plans import casework, devices, evolving, exposure, knowledge, learning, lifecycle, retrieval, telemetry, timeline, upkeep

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for _module in (retrieval, timeline, lifecycle, telemetry, knowledge, devices, upkeep, casework, evolving, learning, exposure):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
FLAGSHIP = "hybrid_gated"
