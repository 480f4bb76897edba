"""Where graphs come from and go to: tables, CSV, JSON and Parquet."""
