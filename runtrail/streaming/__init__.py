"""Streams of event records."""
