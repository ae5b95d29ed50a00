"""Commerce, text and operations analytics expressed as Spark DataFrame jobs."""
