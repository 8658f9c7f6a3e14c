"""Training-data operators on Spark: deduplication, tokenising, extraction and scans over documents."""
