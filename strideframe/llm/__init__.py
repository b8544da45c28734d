"""Training-data operators on Spark: dedup, tokenisation, scoring, extraction, filtering."""
