"""Record-level data quality for tables and streams, written as Spark plans."""

from plumbline.session import checkpoint_dir, cut, get_session

__all__ = ["checkpoint_dir", "cut", "get_session"]
