"""Spark-native audit of what language-model prompts and request logs cost."""
