"""Security-telemetry analytics and corpus preparation on PySpark DataFrames."""
