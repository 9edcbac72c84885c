"""Wiki-corpus analytics on Spark: extraction, audits, search, sync and graph queries as DataFrames."""
