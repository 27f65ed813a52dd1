"""Structured Streaming ingestion of model output and image folders."""
