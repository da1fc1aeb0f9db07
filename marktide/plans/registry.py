"""All queries outside the subpackage for training data, by name, and the SQL that each must agree with."""

from __future__ import annotations

from . import analytics, proofs, ranges, reports, rosters, state, streams, submissions, texts, words

QUERIES = analytics.QUERIES | state.QUERIES | texts.QUERIES | reports.QUERIES | rosters.QUERIES | proofs.QUERIES | words.QUERIES | submissions.QUERIES | streams.QUERIES | ranges.QUERIES
ORACLE_SQL = analytics.ORACLE_SQL | state.ORACLE_SQL | texts.ORACLE_SQL | reports.ORACLE_SQL | rosters.ORACLE_SQL | proofs.ORACLE_SQL | words.ORACLE_SQL | submissions.ORACLE_SQL | streams.ORACLE_SQL | ranges.ORACLE_SQL
