"""Ordered-pipeline analytics on Spark DataFrames."""

from flowseq.flow import Flow, Result
from flowseq.operators.parallel import ByKey, OnDemand, RandomAssign
from flowseq.operators.subflows import link
from flowseq.order import OrderRequired, OrderSpec
from flowseq.sources import characters, elements, from_df, generate, iterate, iterate_column, iterate_optional, range_, read_text, scan

__all__ = [
    "ByKey", "Flow", "OnDemand", "OrderRequired", "OrderSpec", "RandomAssign", "Result", "characters", "elements",
    "from_df", "generate", "iterate", "iterate_column", "iterate_optional", "link", "range_", "read_text", "scan",
]
