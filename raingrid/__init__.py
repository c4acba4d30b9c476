"""raingrid: gridded space-time analytics as Spark jobs."""
