"""The audits over streams: an extension, with the same records kept up to date. Sessions: operators.sessions() with `late`."""

from .audits import stream_null_counts, stream_orphans

__all__ = ["stream_null_counts", "stream_orphans"]
