"""Reading and writing: CSV, Parquet products, commit log, reports, vector collections."""
