"""Structured Streaming jobs: incremental training and question streams."""
