"""Named queries over the driver's tables, each with DuckDB SQL that gives the same rows."""
