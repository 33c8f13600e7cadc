"""Query plans of the audit operators, registered with their SQL."""

from . import aggregate_queries, bank_queries, function_queries, more_queries, nesting_queries, port_queries, review_queries, rule_queries, section_queries, sequence_queries  # noqa: F401
from .catalog import QUERIES, SQL  # noqa: F401
