"""Research on panels of market-style bars, and corpus preparation, as Spark jobs."""
