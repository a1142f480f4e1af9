"""Queries over the test tables, each with the SQL that gives the same rows."""

from kedge.plans import analytics, general, kb, learning, linking, records, scalar

CORE = [general, kb, scalar, linking, analytics, records, learning]
