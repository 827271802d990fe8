"""hirelake: analytics over job-posting data, expressed as Spark DataFrame plans."""
