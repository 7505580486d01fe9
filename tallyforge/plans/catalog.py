"""The registered queries of the library and their SQL."""

from tallyforge.plans import detail_queries, digit_queries, flow_queries, stat_queries, store_queries, table_queries, template_queries, text_queries
from tallyforge.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "detail_queries", "digit_queries", "flow_queries", "stat_queries", "store_queries", "table_queries", "template_queries", "text_queries"]
