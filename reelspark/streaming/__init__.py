"""Structured Streaming versions of the event-driven flows: event time, watermarks, exactly-once batches."""
