"""Named queries over the test tables, each with SQL that was written apart from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewright.plans import grouped, pages, pdf_pages, scores

ALL = pages.ALL | grouped.ALL | pdf_pages.ALL | scores.ALL
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for name, (query, _) in ALL.items()}
ORACLE_SQL: dict[str, str] = {name: sql for name, (_, sql) in ALL.items() if sql}
