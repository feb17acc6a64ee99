"""Spark-native analytics for time-coded conversations, the intervals behind them and large text corpora."""
