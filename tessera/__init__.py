"""Tessera: analytical queries over Parquet, expressed in Spark DataFrames and Spark SQL."""
