"""quadrat: applied statistics on repeated-measures tables, as Spark DataFrame jobs."""
