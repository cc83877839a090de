"""Knowledge-store queries and training-data operators as Spark jobs."""
