"""quillon: telemetry analytics on PySpark DataFrames."""
