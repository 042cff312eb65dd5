"""Structured Streaming: sources, event-time operators, state, sinks and monitoring."""
