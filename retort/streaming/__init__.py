"""Structured Streaming: pipelines by micro-batch and keep-first dedup across them."""

from .stream import dedup_stream, run_stream, seen_keys

__all__ = ["dedup_stream", "run_stream", "seen_keys"]
