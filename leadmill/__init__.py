"""Sales and lead analytics as plain PySpark DataFrame pipelines."""
