"""cuelake: timed-text analytics and corpus operators as Spark DataFrame jobs."""
