"""Live monitoring with Structured Streaming."""
