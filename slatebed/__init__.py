"""Spark-native engine for license-aware asset discovery and usage analytics."""
