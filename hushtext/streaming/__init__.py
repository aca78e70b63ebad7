"""Structured Streaming."""

from hushtext.streaming.stream import redact_file_stream, redact_stream, stream_totals

__all__ = ["redact_file_stream", "redact_stream", "stream_totals"]
