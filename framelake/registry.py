"""All queries of the library by name, with their SQL for DuckDB where there is one."""

from __future__ import annotations

from collections.abc import Callable

from .plans import box_queries, check_queries, event_queries, face_queries, haar_queries, image_queries, job_queries, pixel_queries, stream_queries

MODULES = (box_queries, pixel_queries, face_queries, check_queries, haar_queries, image_queries, job_queries, event_queries, stream_queries)


def queries() -> dict[str, Callable]:
    return {name: run for module in MODULES for name, (run, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
