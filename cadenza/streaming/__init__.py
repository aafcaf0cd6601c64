"""Structured Streaming jobs and the one custom stateful operator."""
