"""kpiforge: retail KPI analytics on Spark DataFrames.

Sub-packages
------------
sources    read the star schema or a wide order-line table (``order_lines``)
functions  Column builders: metrics, dates, numbers, text formatting, tokens
operators  KPI queries, comparisons, drill-downs, insights, dashboard frames,
           fact rows, TF-IDF retrieval, chat-history windows, question tags
plans      validated plan arguments and the dispatcher that runs them
streaming  incremental refresh of the KPI aggregates from a file stream
"""

from kpiforge.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
