from rankspark.sources.tables import articles, jdbc, register, sql, table  # noqa: F401
