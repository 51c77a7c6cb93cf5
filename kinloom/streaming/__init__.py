"""Bounded Structured Streaming matches."""
