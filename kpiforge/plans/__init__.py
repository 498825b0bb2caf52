"""Validated plan arguments and the dispatcher that runs them as DataFrames."""

from kpiforge.plans.plan import KpiPlan, run_plan, validate_plan  # noqa: F401
