"""The registered queries and the SQL that checks them."""

from __future__ import annotations

from gneiss.plans import config_queries, entity_queries, finding_queries, graph_queries, scan_queries, source_queries, store_queries  # noqa: F401
from gneiss.plans.base import ORACLES, QUERIES  # noqa: F401

flagship = QUERIES["corpus_counts"]
