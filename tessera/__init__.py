"""Retrieval, memory and corpus analytics as Spark plans."""
