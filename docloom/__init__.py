"""Spark-first engine for nested-document quality, chat records and corpus preparation."""
