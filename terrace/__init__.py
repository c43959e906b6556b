"""Terrace: league and season analytics as composable Spark DataFrame operators."""
