"""Table operators for layered (raw, clean, report) data on Apache Spark."""
