"""Conversation evidence and training-data jobs on Spark."""
