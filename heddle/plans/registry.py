"""Named queries over the driver tables, and their DuckDB SQL."""

from __future__ import annotations

from heddle.plans import curation_queries, graph_queries, report_queries, rule_queries, sequence_queries

FLAGSHIP = "leverage_queue"
QUERIES: dict = {**graph_queries.QUERIES, **sequence_queries.QUERIES, **curation_queries.QUERIES, **report_queries.QUERIES, **rule_queries.QUERIES}
ORACLE: dict[str, str] = {**graph_queries.ORACLE, **sequence_queries.ORACLE, **curation_queries.ORACLE, **report_queries.ORACLE, **rule_queries.ORACLE}
