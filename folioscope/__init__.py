"""Progress-aware corpus retrieval and answer evaluation as Spark jobs."""
