"""Paged documents and page images on Spark."""
