"""lakeloom: relational, temporal and text analytics written as Spark DataFrame and SQL jobs."""
