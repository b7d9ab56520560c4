"""Independent SQL statements that answer the registered queries on the driver tables."""
