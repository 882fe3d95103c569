"""The registered core queries, and the same results as DuckDB SQL."""

from __future__ import annotations

from weftwork.plans import graphs, relational, symbols

QUERIES = relational.QUERIES | symbols.QUERIES | graphs.QUERIES
SQL = relational.SQL | symbols.SQL | graphs.SQL
flagship = graphs.flagship
