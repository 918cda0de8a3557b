"""Event-driven state as Structured Streaming jobs."""
