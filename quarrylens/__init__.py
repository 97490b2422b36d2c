"""Spark-native analytics and retrieval over filings, call transcripts and long-form metrics."""
