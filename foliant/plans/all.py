"""Importing this module registers every query."""

from foliant.plans import corpus_queries, docx_queries, page_queries, record_queries, text_queries, tracker_queries  # noqa: F401
from foliant.plans.registry import ORACLES, QUERIES  # noqa: F401
