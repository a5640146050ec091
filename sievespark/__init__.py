"""A Spark-native engine for finding exposed credentials and keeping track of them."""
