"""A Spark-native engine for document retrieval and answer-coverage analytics."""
