"""All registered queries: importing this module fills the registry."""

from briskbi.plans import (  # noqa: F401
    chart_queries,
    clean_queries,
    flow_queries,
    segment_queries,
    selection_queries,
    series_queries,
    signal_queries,
    summary_queries,
)
from briskbi.plans.registry import ORACLE, QUERIES  # noqa: F401
