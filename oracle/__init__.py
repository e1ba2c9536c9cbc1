"""Independent SQL statements of what every registered query has to return."""
