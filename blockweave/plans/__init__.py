"""Domain tables from the given tables, jobs composed of operators, and the queries with their SQL."""
