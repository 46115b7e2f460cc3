"""Audit analytics over a company's books, written as Spark DataFrame jobs."""
