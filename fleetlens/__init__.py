"""Location analytics for moving objects, written as Spark DataFrame jobs."""
