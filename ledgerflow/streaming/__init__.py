"""Structured Streaming over landing folders: an extra, batch runs are what the rest is made for."""

from ledgerflow.streaming.landing import landed_events, windowed_counts

__all__ = ["landed_events", "windowed_counts"]
