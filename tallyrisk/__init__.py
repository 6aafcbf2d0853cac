"""Fraud analytics on Spark: quality contract, features, graph, scoring and reports."""
