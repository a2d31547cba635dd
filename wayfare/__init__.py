"""Journey, banner and feedback analytics written as Spark DataFrame jobs."""
