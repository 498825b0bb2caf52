"""Sources: the driver's parquet tables, the star-to-wide adapter and loaders."""

from kpiforge.sources.tables import read_table, TABLES  # noqa: F401
from kpiforge.sources.order_lines import (  # noqa: F401
    order_lines, load_orders, coerce_order_lines, filter_options, preview,
    latest_order_date, latest_wide_date, materialize_order_lines, read_order_lines_jdbc, run_sql, ORDER_LINES_COLUMNS,
)
