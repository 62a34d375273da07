"""All registered queries of the library's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinesieve.plans import boards, calibration, containers, extras, frames, geometry, matching, measures, paths, renders, reports, rotations, sequences, solvers

MODULES = (sequences, matching, measures, geometry, solvers, extras, frames, boards, reports, paths, calibration, containers, rotations, renders)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
