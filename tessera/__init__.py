"""tessera: analytical queries and corpus preparation as plain PySpark jobs."""
