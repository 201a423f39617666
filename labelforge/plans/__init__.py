"""Query plans over the test tables: derived inputs, the query catalogue and
the DuckDB oracle SQL that checks it."""
