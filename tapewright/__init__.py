"""Spark-native analytics for market data and company filings."""
