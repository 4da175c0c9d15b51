"""Incremental jobs."""

from siftline.streaming.review_stream import batch_folders, review_stream, stream_source_files

__all__ = ["batch_folders", "review_stream", "stream_source_files"]
