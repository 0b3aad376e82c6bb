"""The queries that the engine registers, and the DuckDB SQL that each is compared with."""

from __future__ import annotations

from veritab.plans import assembly, hierarchies, placing, records, scoring

FLAGSHIP = "embedding_match_metrics"
QUERIES = scoring.QUERIES | hierarchies.QUERIES | assembly.QUERIES | placing.QUERIES | records.QUERIES
ORACLE_SQL = scoring.ORACLE_SQL | hierarchies.ORACLE_SQL | assembly.ORACLE_SQL | placing.ORACLE_SQL | records.ORACLE_SQL
