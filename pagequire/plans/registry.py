"""All queries over the standard tables, each with its SQL where SQL can express it.

The standard tables hold no comics pages; each query projects them onto the columns that its operator takes, over all
rows. Names begin with the operators' numbers.
"""

from __future__ import annotations

from . import documents, layout, lookups, script, settings, status, texts

QUERIES = status.QUERIES | lookups.QUERIES | layout.QUERIES | texts.QUERIES | script.QUERIES | settings.QUERIES | documents.QUERIES
ORACLE_SQL = status.ORACLE_SQL | lookups.ORACLE_SQL | layout.ORACLE_SQL | texts.ORACLE_SQL | script.ORACLE_SQL | settings.ORACLE_SQL | documents.ORACLE_SQL
