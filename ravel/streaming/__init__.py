"""Structured Streaming jobs (T1–T5) and the data-anchored rate windows."""
