"""Job-posting intelligence as Spark jobs."""
