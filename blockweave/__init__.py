"""Block analytics as DataFrame operators and Structured Streaming jobs."""
