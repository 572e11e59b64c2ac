"""Quote analytics on Spark: feeds, freshness, opportunities, signals, identity and operations."""
