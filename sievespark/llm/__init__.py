"""Training-data operators: scans, filters, dedup, tokenising, sharding and archives on Spark."""
