"""Unbounded inputs with Structured Streaming."""

from .streams import file_stream, interval_join, run_available, running_sum_stream, session_counts, sliding_counts, tumbling_counts

__all__ = ["file_stream", "interval_join", "run_available", "running_sum_stream", "session_counts", "sliding_counts", "tumbling_counts"]
