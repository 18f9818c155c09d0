"""Spark-native stream pipelines: composable stages over bounded tables and unbounded streams."""
