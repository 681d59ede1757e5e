"""Spark-first engine for chunking, retrieving, verifying and evaluating collections of structured legal text."""
