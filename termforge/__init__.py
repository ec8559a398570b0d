"""termforge: full-text search and analytics as plain Spark plans."""
