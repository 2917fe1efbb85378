"""Analytics for range-partitioned key-value clusters on Spark."""
