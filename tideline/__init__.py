"""Analytics over durable-workflow tables, as Spark jobs."""
