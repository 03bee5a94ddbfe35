"""All registered queries with their SQL, collected from the modules of this package."""

from __future__ import annotations

from tidemark.plans import event_queries, feature_queries, revision_queries, scalar_queries, source_queries, statistics_queries, streaming_queries, target_queries

MODULES = [feature_queries, event_queries, statistics_queries, target_queries, revision_queries, scalar_queries, streaming_queries, source_queries]
QUERIES: dict = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE: dict = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
