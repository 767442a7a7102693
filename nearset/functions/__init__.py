"""Column functions: plain ``pyspark.sql`` expressions, no Python UDFs."""
