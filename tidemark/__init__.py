"""tidemark: page observation, session and text analytics as Spark DataFrame jobs."""
