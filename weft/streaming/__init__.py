"""Queries over streams."""

from .rows import open_stream, start

__all__ = ["open_stream", "start"]
