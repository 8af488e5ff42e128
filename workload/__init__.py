"""Every operator as a query over the test tables, and its DuckDB counterpart."""
