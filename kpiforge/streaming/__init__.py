"""Structured Streaming: keep KPI aggregates current as order-line files arrive."""

from kpiforge.streaming.refresh import kpi_updates, start_refresh  # noqa: F401
