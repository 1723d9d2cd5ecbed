"""Market-regime datasets and forecast evaluation as Spark DataFrame jobs."""
