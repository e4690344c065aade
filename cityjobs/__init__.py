"""Spark jobs for a text knowledge base, open-data reports and conversation scores."""
