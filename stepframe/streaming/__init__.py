"""Row-wise plans on streams."""

from .stream import check_streamable, stream_table, transform_stream

__all__ = ["check_streamable", "stream_table", "transform_stream"]
