"""Tidemark: environmental-monitoring analytics as PySpark DataFrame jobs."""

from tidemark.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
