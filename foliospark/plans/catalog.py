"""All operations by name, their queries and their SQL."""

from __future__ import annotations

from foliospark.plans import cells, compare, jobs, layout, pages, raster, regions, streams, text  # noqa: F401  registers
from foliospark.plans.registry import OPERATIONS, ORACLES, Query, latest


def FLAGSHIP(spark, sf_dir):  # noqa: N802
    return OPERATIONS["d4_compare_documents.v1"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return latest(OPERATIONS)


def oracle_sql() -> dict[str, str]:
    return latest(ORACLES)
