"""Scoring and reporting of graph question answering on Spark."""
