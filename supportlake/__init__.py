"""supportlake: customer-support knowledge data as Spark DataFrame and streaming jobs."""
