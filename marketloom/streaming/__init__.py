"""Structured Streaming variants of the article and feature jobs."""
