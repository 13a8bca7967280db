"""A Spark-native engine for analytics and automated feature engineering."""
