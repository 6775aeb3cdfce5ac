"""The event queue as batch rules and as Structured Streaming."""
