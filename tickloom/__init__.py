"""tickloom: technical analysis of price series as Spark jobs."""
