"""Teaching documents to reviewable exercises, grading and run analytics, as Spark jobs."""
